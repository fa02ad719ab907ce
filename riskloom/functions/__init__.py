"""Column functions: amounts, event time, text and hashes. All are built-in expressions."""

from riskloom.functions.amount import *  # noqa: F401,F403
from riskloom.functions.text import *  # noqa: F401,F403
from riskloom.functions.time import *  # noqa: F401,F403

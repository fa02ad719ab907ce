"""Order-free comparison of result rows."""

import decimal
import math


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def sorted_rows(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)

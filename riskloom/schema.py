"""Column roles, declared schemas and the short code lists that have fixed meaning."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------------
INSTITUTION_CODES = [
    "acq_ins_id_cd", "fwd_ins_id_cd", "rcv_ins_id_cd", "iss_ins_id_cd", "related_ins_id_cd",
    "acpt_ins_id_cd", "settle_fwd_ins_id_cd", "settle_rcv_ins_id_cd", "acct_ins_id_cd",
]
FRAUD_LIST_COLUMNS = ["sys_tra_no", "pri_acct_no_conv", "mchnt_cd", "pdate", "fraud_tp"]
FRAUD_LIST_LONG_COLUMNS = [
    "sys_tra_no", "trans_dt", "tfr_dt_tm", "pri_acct_no_conv", "term_id", "trans_region", "mchnt_cd", "fraud_tp",
]

HIGH_RISK_REGION_PREFIXES = ["39", "40", "41", "42", "43", "44", "64"]
HIGH_RISK_MCC = [
    "4214", "4511", "5065", "5094", "5211", "5251", "5310", "5331", "5533", "5712", "5722", "5732", "5932",
    "5947", "5993", "7221",
]
LOW_RISK_MCC = [
    "3999", "4111", "4899", "5309", "5960", "6012", "6051", "6300", "6513", "8011", "8043", "8062", "8099",
    "8211", "8220", "8398", "8888", "9311", "9399",
]
RESPONSE_OK = "00"
CARDHOLDER_FAILURE_CODES = ["51", "55", "61", "65", "75"]
NIGHT_HOURS = [23, 0, 1, 2, 3, 4, 5]
# The shorter merchant-category groups; a caller adds its own through ``group_counts(groups=...)``.
MCC_GROUPS = {
    "risk": ["5912", "7297", "7298", "4835"],
    "high_risk": ["5976", "7995", "4835", "5933", "9211", "9222", "9223"],
    "utilities": ["4900"],
    "jewellery": ["5094", "5944", "5950", "5970", "5971"],
    "lodging": ["7011", "7012"],
    "real_estate": ["1520", "7013"],
    "finance": [
        "5933", "6051", "6211", "6300", "6010", "6011", "6012", "9498", "6013", "6050", "8888", "9991", "5690",
        "6014",
    ],
    "rental": ["4457", "4468", "7296", "7394", "7512", "7513", "7519", "7841"],
    "logistics": ["4011", "4214", "4215", "4225", "9402"],
    "education": ["8211", "8220", "8241", "8244", "8249", "8299", "8351", "8229"],
    "health": ["8011", "8021", "8031", "8041", "8042", "8049", "8050", "8062", "8071", "8099"],
    "associations": ["8641", "8651", "8661", "8699"],
    "direct_sale": ["5960", "5962", "5963", "5964", "5965", "5966", "5967", "5968", "5969"],
    "lottery": ["7995", "4835"],
    "fines": ["9222"],
}
ACTIVITY_EDGES = [0, 5, 10, 20, 30, 40, 50, 100, 200, 500]
AMOUNT_EDGES = [0, 10, 100, 1000, 10000, 100000, 1000000, 10000000, 100000000, float("inf")]
# Hours of the day: one each up to eleven, the rest of the day together.
HOUR_EDGES = [*range(12), 24]
# --- end of fixed values ----------------------------------------------------------------------


def text_schema(names: Iterable[str]) -> T.StructType:
    """All-string schema for delimited stage files."""
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def indexed_schema(key: str, names: Iterable[str]) -> T.StructType:
    """One string key followed by doubles."""
    return T.StructType(
        [T.StructField(key, T.StringType(), True)] + [T.StructField(n, T.DoubleType(), True) for n in names]
    )


@dataclass(frozen=True)
class TxnSchema:
    """Which column plays which role, so operators need no fixed names."""

    card: str
    ts: str
    amount: str
    txn_id: str
    label: str | None = None
    merchant: str | None = None
    terminal: str | None = None
    location: str | None = None
    category: str | None = None
    response: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def columns(self) -> list[str]:
        named = [self.card, self.ts, self.amount, self.txn_id, self.label, self.merchant, self.terminal,
                 self.location, self.category, self.response, *self.extra.values()]
        return list(dict.fromkeys(n for n in named if n))

    def select(self, df: DataFrame) -> DataFrame:
        """Column pruning up front: only the role columns travel through the shuffles."""
        return df.select(*self.columns())

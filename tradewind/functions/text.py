"""String column functions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def title_case(s) -> Column:
    """Python ``str.title()``: every run of letters starts upper-case.

    ``initcap`` only capitalises after blanks ("men's t-shirt" ->
    "Men's T-shirt"); Python gives "Men'S T-Shirt". Split before every
    letter that follows a non-letter, capitalise each piece, join back.
    """
    parts = F.split(_c(s), r"(?<=[^\p{L}])(?=\p{L})")
    fixed = F.transform(parts, lambda p: F.concat(
        F.upper(p.substr(F.lit(1), F.lit(1))), F.lower(p.substr(F.lit(2), F.length(p)))))
    return F.array_join(fixed, "")


def category_label(s) -> Column:
    """Category display text: underscores to blanks, then title case."""
    return title_case(F.regexp_replace(_c(s), "_", " "))


def prefix(s, n: int) -> Column:
    """``str(x)[:n]``."""
    return F.substring(_c(s), 1, n)


# Fixed patterns for ids inside alert messages (word, blanks, optional
# back-quote, id characters). Words: customer "Khách", seller "Seller",
# order "Đơn".
ENTITY_ID_CHARS = "[A-Za-z0-9_-]+"
CUSTOMER_WORD = "Khách"
SELLER_WORD = "Seller"
ORDER_WORD = "Đơn"


def entity_pattern(word: str) -> str:
    return word + r"\s+`?(" + ENTITY_ID_CHARS + ")`?"


def extract_entity(msg, word: str) -> Column:
    """First id after ``word``; null when there is no match."""
    return F.nullif(F.regexp_extract(_c(msg), entity_pattern(word), 1), F.lit(""))


def mask_email(s) -> Column:
    """Keep the first character of the local part and the domain.

    ``jane.doe@example.com`` -> ``j***@example.com``. Works on whole texts:
    every address inside the string is masked.
    """
    return F.regexp_replace(
        _c(s), r"([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2")


def mask_name(s) -> Column:
    """First letter of every word followed by ``***``."""
    return F.regexp_replace(_c(s), r"(\S)\S*", "$1***")

"""Personal data in text: detect, redact, hash, summarise.  Columns only, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.pystr import bind, java_regex

# The patterns in the order they are applied.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "mac_address": r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b",
    "username": r"""\buser[name]?\s*=\s*['"][^'"]+['"]""",
    "password": r"""\bpass[word]?\s*=\s*['"][^'"]+['"]""",
}
# Capture groups per pattern, and a character every match must hold.
PII_GROUPS = {"phone": 3, "mac_address": 2}
PII_NEEDS = {"email": "@", "ssn": "-", "ip_address": ".", "username": "=", "password": "="}


def _matches(text: Column, kind: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java_regex(PII_PATTERNS[kind])), group)


def pii_map(text: Column) -> Column:
    """``MAP<type, matches>`` of the types found."""
    entries = []
    for kind in PII_PATTERNS:
        found = _matches(text, kind)
        if kind in PII_NEEDS:
            # A plain search spares the pattern on texts that cannot match.
            found = F.when(F.contains(text, F.lit(PII_NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))
        entries.append(F.struct(F.lit(kind).alias("key"), found.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def _hits(text: Column, kind: str) -> Column:
    """The matches of one type as structs; null on texts that cannot match."""
    n = PII_GROUPS.get(kind, 0)
    # Whole matches and groups side by side, so the lambda looks nothing up.
    zipped = F.arrays_zip(
        _matches(text, kind).alias("m"), *[_matches(text, kind, g).alias(f"g{g}") for g in range(1, n + 1)]
    )

    def hit(z, i):
        captured = F.array(*[z[f"g{g}"] for g in range(1, n + 1)]) if n else F.array().cast("array<string>")
        return F.struct(
            F.lit(kind).alias("pii_type"), (i + 1).alias("match_no"), z["m"].alias("match"), captured.alias("groups")
        )

    found = F.transform(zipped, hit)
    search = F.rlike(text, F.lit(java_regex(PII_PATTERNS[kind])))
    if kind in PII_NEEDS:
        search = F.contains(text, F.lit(PII_NEEDS[kind])) & search
    return F.when(search, found)


def detect(rows: DataFrame, text: str = "text") -> DataFrame:
    """``pii_type, match_no, match, groups`` for every match; ``groups`` as the pattern captures."""
    carried = [c for c in rows.columns if c != text]
    per_type = [_hits(F.col(text), kind) for kind in PII_PATTERNS]
    empty = F.array().cast("array<struct<pii_type:string,match_no:int,match:string,groups:array<string>>>")
    everything = F.concat(*[F.coalesce(p, empty) for p in per_type])
    # The outer form keeps the optimizer from running every pattern once more as a filter.
    return (
        rows.select(*carried, F.explode_outer(everything).alias("hit"))
        .where("hit is not null")
        .select(*carried, "hit.*")
    )


def _mask(match: Column, char: str) -> Column:
    n = F.length(match)
    middle = F.repeat(F.lit(char), n - 4)
    return F.when(n <= 4, F.repeat(F.lit(char), n)).otherwise(
        F.concat(F.substring(match, 1, 2), middle, F.right(match, F.lit(2)))
    )


def redact(text: Column, char: str = "*") -> Column:
    """The text with matches masked, pattern after pattern.

    Texts without any match, the bulk, take only the searches; the rest are cut at the
    matches and joined again with the masked pieces between.
    """

    def step(kind):
        pattern = F.lit(java_regex(PII_PATTERNS[kind]))

        def rewrite(x):
            masked = F.transform(F.regexp_extract_all(x, pattern, 0), lambda m: _mask(m, char))
            pieces = F.split(x, java_regex(PII_PATTERNS[kind]), -1)
            woven = bind(
                masked,
                lambda ready: F.transform(
                    pieces, lambda piece, i: F.concat(piece, F.coalesce(F.get(ready, i), F.lit("")))
                ),
            )
            return F.when(F.rlike(x, pattern), F.array_join(woven, "")).otherwise(x)

        return rewrite

    any_match = F.lit(False)
    for kind in PII_PATTERNS:
        search = F.rlike(text, F.lit(java_regex(PII_PATTERNS[kind])))
        if kind in PII_NEEDS:
            search = F.contains(text, F.lit(PII_NEEDS[kind])) & search
        any_match = any_match | search
    out = text
    for kind in PII_PATTERNS:
        out = bind(out, step(kind))
    return F.when(any_match, out).otherwise(text)


def hash_sensitive(text: Column, salt: str = "") -> Column:
    return F.substring(F.sha2(F.concat(text, F.lit(salt)), 256), 1, 16)


def protect(rows: DataFrame, text: str = "text", char: str = "*") -> DataFrame:
    """Add ``protected_text`` and ``pii_types``, the types to be audited."""
    return rows.withColumns(
        {"pii_types": F.map_keys(pii_map(F.col(text))), "protected_text": redact(F.col(text), char)}
    ).drop(text)


def pii_summary(detected: DataFrame, by=()) -> DataFrame:
    """Matches and rows hit per type."""
    return detected.groupBy(*by, "pii_type").agg(
        F.count("*").alias("n_matches"), F.count_if(F.col("match_no") == 1).alias("n_rows")
    )

"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations read bits only.

A ledger has a row a document: its id, the measurements, and `failures`, where bit i is set if rule i of RULES fails. A
policy is a version and the names of the rules that it enforces, so a mask; policies of any version, and what each of
their rules does, come from a stored ledger without reading a text again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_texts, ship

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Words of a window that is looked for twice.
WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Each rule's condition of failure over the measurements. A rule's place is its bit: rules are added at the end, and one
#: that changes gets a new name, so that ledgers of any age stay readable.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines",
    "very_many_words": "n_words > 100000",
}

#: Versions of the policy. The last is the one in force.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "short_words", "long_words", "very_many_words"),
    "v2": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines"),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of consecutive words that the text has at least twice, each counted once."""
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    at = ids
    for k in range(1, window):  # windows by number: of the window a word shorter and the next word; both are below len(words)
        at = at[:-1] * len(known) + ids[k:]
        at = np.unique(at, return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(at)[at] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + window, -1)
    return int(np.count_nonzero(np.cumsum(covered)))


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of a text in UTF-8. bytes.split() and strip() know the six ASCII blanks that part words, and no others."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _measures():
    def values(texts: pa.Array) -> list[pa.Array]:
        rows = [measure((x.as_py() or "").encode()) for x in texts]
        return [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(MEASURES)

    return values


def mask(rules: tuple[str, ...] | list[str]) -> int:
    """The bits of these rules."""
    places = {name: i for i, name in enumerate(RULES)}
    return sum(1 << places[r] for r in dict.fromkeys(rules))


def ledger(df: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """id_cols, MEASURES and `failures` of every row of df: each rule of RULES is evaluated once, over the whole text.

    Nothing is shuffled and each text is read once, where it lies; one text at a time is in memory beside its batch. Null,
    empty and blank texts measure 0 everywhere and fail few_words alone. Rows repeat as they come, null ids are ids, and
    other columns, whatever their names, are not read. An empty table gives an empty ledger.
    """
    ship(df.sparkSession)
    measured = over_texts(df, list(id_cols), text_col, _measures, ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.expr(f"IF({condition}, {1 << i}L, 0L)") for i, condition in enumerate(RULES.values())]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured.withColumn("failures", failures)


def write_ledger(df: DataFrame, path: str, **how) -> None:
    """The ledger of df as Parquet at path, some 60 bytes a document."""
    ledger(df, **how).write.parquet(path)


def passes(policy: tuple[str, ...] | list[str], failures: str = "failures") -> Column:
    """Whether a row of a ledger passes all rules of the policy."""
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) == 0


def sole_rule(policy: tuple[str, ...] | list[str], failures: str = "failures") -> Column:
    """The one rule of the policy without which the row would pass; null if it passes or fails several."""
    failed = F.col(failures).bitwiseAND(F.lit(mask(policy)))
    name = F.lit(None).cast("string")
    for i, rule in enumerate(RULES):
        name = F.when(failed == 1 << i, rule).otherwise(name)
    return name


def apply_policies(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """A stored ledger with a column kept_<version> for each policy. An empty policy keeps everything."""
    return rows.withColumns({f"kept_{version}": passes(p) for version, p in policies.items()})


def ablations(rows: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """version, rule, failed, failed_alone, kept, kept_without: what each rule of each policy does to a stored ledger.

    Documents are first counted by their failure bits, on the map side: at most 2^rules rows are shuffled from each task
    and all versions' figures are bitwise tests on these counts. kept_without is what the policy keeps when the rule is
    left out. A policy over an empty ledger has zeros.
    """
    counts = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    wanted = [(v, r, mask((r,)), mask(p)) for v, p in policies.items() for r in p]
    rules = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit"), F.lit(m).cast("long").alias("mask")) for v, r, b, m in wanted])
    each = counts.select("failures", "n", F.inline(rules))
    n = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    failed = F.col("failures").bitwiseAND(F.col("mask"))
    figures = each.groupBy("version", "rule").agg(
        n(failed.bitwiseAND(F.col("bit")) != 0, "failed"), n(failed == F.col("bit"), "failed_alone"), n(failed == 0, "kept"), n((failed == 0) | (failed == F.col("bit")), "kept_without")
    )
    all_rules = rows.sparkSession.createDataFrame([(v, r) for v, r, _, _ in wanted], "version string, rule string")
    return all_rules.join(figures, ["version", "rule"], "left").fillna(0)

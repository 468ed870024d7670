"""Validation and cleaning of labelled text.

One loader with flags covers the strict and the lenient behaviour:
``require`` (columns), ``drop_blank`` and ``allowed_labels`` + ``strict``.
All steps are narrow projections/filters; only the strict label check runs
a job (a distinct over the label column).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import LABELS, REQUIRED_STRICT
from ..functions.text import normalise_label, strip
from ..sources.labelled import check_required


def drop_null(df: DataFrame, cols: Sequence[str] = ("text", "label")) -> DataFrame:
    """Drop rows whose text or label is null (before any trim)."""
    return df.dropna(subset=list(cols))


def clean_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Cast to string and strip Unicode whitespace."""
    return df.withColumn(col, strip(F.col(col).cast("string")))


def clean_label(df: DataFrame, col: str = "label") -> DataFrame:
    """Strip + lower-case the label."""
    return df.withColumn(col, normalise_label(F.col(col).cast("string")))


def non_blank(df: DataFrame, col: str = "text") -> DataFrame:
    """Keep rows whose stripped text is not empty."""
    return df.where(F.col(col) != F.lit(""))


def invalid_label_rows(df: DataFrame, allowed: Iterable[str] = LABELS, col: str = "label") -> DataFrame:
    """P5 quarantine: the rows whose label is outside the allowed set."""
    return df.where(~F.col(col).isin(*allowed))


def label_except(df: DataFrame, allowed: Iterable[str] = LABELS, col: str = "label") -> DataFrame:
    """Distinct observed labels minus the allowed ones (a set difference).

    The allowed set is a literal; ``isin`` keeps it a filter before the
    distinct aggregate (partial aggregation, no join).
    """
    return df.select(col).where(~F.col(col).isin(*allowed)).distinct()


def check_labels(df: DataFrame, allowed: Iterable[str] = LABELS, col: str = "label", shown: int = 20) -> None:
    """P5 strict: raise ``ValueError`` with the number of unknown labels and their
    names; where there are more than ``shown``, it says how many are left out."""
    bad = label_except(df, allowed, col)
    first = [str(r[0]) for r in bad.orderBy(col).limit(shown + 1).collect()]
    if first:
        more = bad.count() - shown if len(first) > shown else 0
        names = f"{first[:shown]} and {more} more" if more else str(first)
        raise ValueError(f"unsupported labels: {names}")


def clean_labelled(
    df: DataFrame,
    require: Iterable[str] = REQUIRED_STRICT,
    drop_blank: bool = True,
    allowed_labels: Iterable[str] | None = LABELS,
    strict: bool = True,
) -> DataFrame:
    """The loader's clean step: P1 -> P2 -> P3 -> [P4] -> [P5].

    strict=True raises on unknown labels (one extra job); strict=False keeps
    them, so ``label_encode`` gives them a null ``label_id``.
    """
    check_required(df, require)
    out = clean_label(clean_text(drop_null(df)))
    if drop_blank:
        out = non_blank(out)
    if allowed_labels is not None and strict:
        check_labels(out, allowed_labels)
    return out


#: Why a row is rejected, in the order in which the reasons are tried.
REJECT_REASONS = ("null_text", "null_label", "blank_text", "unknown_label")


@dataclass
class Checked:
    """A validated table: its good rows, its quarantine, and the rows counted by reason while it was written."""

    good: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def reject_reason(text: Column, label: Column, drop_blank: bool = True,
                  allowed_labels: Iterable[str] | None = LABELS) -> Column:
    """Why the cleaning steps P1 to P5 would drop a raw row, or null."""
    reason = F.when(text.isNull(), "null_text").when(label.isNull(), "null_label")
    if drop_blank:
        reason = reason.when(strip(text.cast("string")) == "", "blank_text")
    if allowed_labels is not None:
        reason = reason.when(~normalise_label(label.cast("string")).isin(*allowed_labels), "unknown_label")
    return reason


def clean_to_table(df: DataFrame, path: str, require: Iterable[str] = REQUIRED_STRICT, drop_blank: bool = True,
                   allowed_labels: Iterable[str] | None = LABELS, strict: bool = True) -> Checked:
    """P1 to P5 in one pass: the input is read once, cleaned, judged, counted and written.

    Below ``path`` the rows lie by ``rejected``: good rows cleaned, rejected
    rows as they came, with their ``reject_reason``. The rows of each reason
    are counted by an observation of the write itself, looked at when the write
    is done: with ``strict`` unknown labels raise ``ValueError`` with their number
    and two of them, and the quarantine stays for inspection."""
    check_required(df, require)
    reason = reject_reason(F.col("text"), F.col("label"), drop_blank, allowed_labels)
    fine = F.col("reject_reason").isNull()
    judged = df.withColumn("reject_reason", reason)
    judged = judged.withColumns({
        "text": F.when(fine, strip(F.col("text").cast("string"))).otherwise(F.col("text").cast("string")),
        "label": F.when(fine, normalise_label(F.col("label").cast("string"))).otherwise(F.col("label").cast("string")),
        "rejected": ~fine})
    seen = Observation()
    unknown = F.when(F.col("reject_reason") == "unknown_label", F.col("label"))
    observed = judged.observe(
        seen, F.count("*").alias("rows"), F.count_if(fine).alias("good"),
        *[F.count_if(F.col("reject_reason") == r).alias(r) for r in REJECT_REASONS],
        F.min(unknown).alias("first_unknown"), F.max(unknown).alias("last_unknown"))
    observed.write.mode("overwrite").partitionBy("rejected").parquet(path)
    found = seen.get
    counts = {k: int(found[k]) for k in ("rows", "good", *REJECT_REASONS)}
    if strict and counts["unknown_label"]:
        raise ValueError(f"unsupported labels in {counts['unknown_label']} of {counts['rows']} rows, such as "
                         f"{found['first_unknown']!r} and {found['last_unknown']!r}; see {path}")
    table = df.sparkSession.read.schema(judged.schema).parquet(path)
    return Checked(table.where(~F.col("rejected")).drop("rejected", "reject_reason"),
                   table.where("rejected").drop("rejected"), counts)


def label_encode(df: DataFrame, labels: Sequence[str] = LABELS, col: str = "label",
                 out: str = "label_id") -> DataFrame:
    """Label -> id by a literal map (constant-folded); a miss is null."""
    m = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
    return df.withColumn(out, m[F.col(col)].cast("int"))


def label_decode(df: DataFrame, labels: Sequence[str] = LABELS, col: str = "label_id",
                 out: str = "label") -> DataFrame:
    """Id -> label; an id out of range is null (``get``, ANSI-safe)."""
    return df.withColumn(out, F.get(F.array(*[F.lit(x) for x in labels]), F.col(col).cast("int")))


def project_rename(df: DataFrame) -> DataFrame:
    """Keep the training columns, ``label_id`` renamed to ``label``."""
    return df.select("text", F.col("label_id").alias("label"))

"""Quality rules: plain limits, then robust multivariate outliers.

Each document gets word and line statistics. Some plain limits reject it
outright; the others are judged by the minimum covariance determinant (MCD): in
each language and source the 75 % of documents whose statistics have the
covariance of least determinant are found by concentration steps, and a document
is rejected if its Mahalanobis distance from their mean, by their covariance, is
beyond the chosen tail of the chi-square distribution.

All of it is DataFrame expressions. The statistics are computed inside a row
with array functions; a concentration step is two aggregates over the narrow
statistics table: a histogram of distances (its bin at 75 % is the cut, so no
sort and no sampled quantile is needed) and the moments of the rows within. A
source with a third of all documents is summed map-side like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, read_table, stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of a group's documents that the estimate rests on.
CORE = 0.75
#: Concentration goes on until no group's log determinant moves by more, or for so many steps.
CONVERGED, MAX_STEPS = 1e-6, 12
#: A clean document is rejected with about this probability if the statistics are normal.
TAIL = 1e-5
#: A group with fewer documents is judged by the estimate of its whole language, or else of all documents.
MIN_GROUP = 200
#: Words (or lines) added to a document before its shares are taken, so that short texts are not extreme by chance.
PRIOR_WORDS, PRIOR_LINES, PRIOR_WORD_CHARS = 50, 5, 5.0
#: The transformed statistics, with the least standard deviation each is given: small enough that each statistic can
#: reject a document alone, large enough that one repeated line or window does not where the core has none.
DIMENSIONS = {"x_word_chars": 0.25, "x_symbols": 0.06, "x_dup_lines": 0.1, "x_repeats": 0.075}
P = len(DIMENSIONS)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
DISTANCE_BINS = 32


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def window_hashes(words: Column) -> Column:
    """A hash for each run of eight words, from hashes of runs of one, two and four."""
    def doubled(hashes: Column, step: int) -> Column:
        return let(hashes, lambda h: F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h), F.lit(1))),
                                                lambda a, b: F.xxhash64(a, b)))

    eight = doubled(doubled(doubled(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)
    return let(eight, lambda h: F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))


def words_in_repeated_windows(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            def twin(k: Column) -> Column:
                return F.get(s, k)["h"]

            return F.sort_array(F.transform(
                F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                         lambda k: (F.coalesce(twin(k) == F.get(s, k - 1)["h"], F.lit(False)))
                         | F.coalesce(twin(k) == F.get(s, k + 1)["h"], F.lit(False))),
                lambda k: F.get(s, k)["i"]))

        def length(at: Column) -> Column:
            steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))),
                               lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda n, s: n + s)

        return let(let(ordered, positions), length)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns plus the base statistics; a null text has none of anything."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    words = words_of(value)
    counted = docs.withColumns({
        "_words": let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            words_in_repeated_windows(window_hashes(w)).cast("long").alias("n_repeat_words"))),
        "word_chars": F.length(F.translate(value, SPACES, "")).cast("long"),
        "n_symbols": (F.length(value) - F.length(F.translate(value, SYMBOLS, ""))).cast("long"),
        "_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
    })
    return counted.withColumns({
        "n_words": F.col("_words.n_words"),
        "n_repeat_words": F.col("_words.n_repeat_words"),
        "n_dup_lines": F.col("_lines.dup"),
        "n_lines": F.col("_lines.n"),
    }).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).drop("_words", "_lines")


def with_vector(rated: DataFrame) -> DataFrame:
    """The transformed statistics: shares with a prior, square roots of rare ones."""
    n = F.col("n_words") + PRIOR_WORDS
    return rated.withColumns({
        "x_word_chars": (F.col("word_chars") + PRIOR_WORDS * PRIOR_WORD_CHARS) / n,
        "x_symbols": F.sqrt(F.col("n_symbols") / n),
        "x_dup_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES)),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / n),
    })


def chi_square(x: float, half_degrees: int) -> float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half_degrees))


def chi_square_quantile(share: float, half_degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, half_degrees) < share else (low, middle)
    return low


def tail_probability(distance_: Column, core_n: Column) -> Column:
    """Chance of a distance this large: F distribution with ``P`` (even, here 4)
    and ``core_n - P`` degrees of freedom, the chi-square of ``P`` for a large
    core. It is 1 where the core has too few rows for a covariance."""
    free = F.greatest(core_n - P, F.lit(0)) / 2
    z = 1 / (1 + distance_ / F.greatest(core_n - 1, F.lit(1)))
    return F.pow(z, free) * (1 + free * (1 - z))


def estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, inverse Cholesky factor and log determinant of each group's covariance."""
    names = list(DIMENSIONS)
    moments = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(names)],
        *[F.avg(F.col(names[i]) * F.col(names[j])).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)])
    least = list(DIMENSIONS.values())
    out = moments.withColumns({
        f"c{i}{j}": F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (least[i] ** 2 if i == j else 0.0)
        for i in range(P) for j in range(i + 1)})
    for j in range(P):  # Cholesky factor, a column at a time
        taken = sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - taken, F.lit(least[j] ** 2))))
        out = out.withColumns({
            f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)))
            / F.col(f"l{j}{j}") for i in range(j + 1, P)}) if j + 1 < P else out
    for i in range(P):  # its inverse, a row at a time
        out = out.withColumns({f"w{i}{j}": (
            (F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)))
            / F.col(f"l{i}{i}")) for j in range(i + 1)})
    log_det = sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))
    return out.select(*keys, "n", *[f"m{i}" for i in range(P)],
                      *[f"w{i}{j}" for i in range(P) for j in range(i + 1)], log_det.alias("log_det"))


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's estimate."""
    names = list(DIMENSIONS)
    total = F.lit(0.0)
    for i in range(P):
        part = sum((F.col(f"w{i}{j}") * (F.col(names[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + part * part
    return total


def concentrate(rows: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """One concentration step: estimates from each group's ``CORE`` share of nearest rows."""
    near = rows.join(estimate, "group").withColumn(
        "bin", F.floor(F.log(distance() + 1e-9) * DISTANCE_BINS).cast("int"))
    bins = near.groupBy(*keys, "bin").agg(F.count("*").alias("k"))
    upto = Window.partitionBy(*keys).orderBy("bin")
    cuts = (bins.withColumn("below", F.sum("k").over(upto) - F.col("k"))
            .withColumn("all", F.sum("k").over(Window.partitionBy(*keys)))
            .where(F.col("below") < CORE * F.col("all")).groupBy(*keys).agg(F.max("bin").alias("cut")))
    cuts = stored(cuts, "cuts")  # a row for each group, whose known size spares its rows a shuffle by group
    return estimates(near.select(*keys, "bin", *DIMENSIONS).join(cuts, keys).where("bin <= cut"), keys)


def robust_estimates(rows: DataFrame) -> DataFrame:
    """The MCD estimate of each ``group``, by concentration from two starts."""
    names = list(DIMENSIONS)
    rows = rows.select("group", *names)
    whole = estimates(rows, ["group"])
    # a second start: rows near the middle of the group by the least deviations alone
    medians = None
    for i, (x, step) in enumerate(DIMENSIONS.items()):
        bins = rows.groupBy("group", F.floor(F.col(x) / step * 8).alias("bin")).agg(F.count("*").alias("k"))
        upto = Window.partitionBy("group").orderBy("bin")
        middle = (bins.withColumn("upto", F.sum("k").over(upto))
                  .withColumn("all", F.sum("k").over(Window.partitionBy("group")))
                  .where(2 * F.col("upto") >= F.col("all")).groupBy("group")
                  .agg(((F.min("bin") + 0.5) * step / 8).alias(f"m{i}")))
        medians = middle if medians is None else medians.join(middle, "group")
    plain = medians.select("group", F.lit(1).cast("long").alias("n"), *[f"m{i}" for i in range(P)],
                           *[F.lit(1 / list(DIMENSIONS.values())[i] if i == j else 0.0).alias(f"w{i}{j}")
                             for i in range(P) for j in range(i + 1)], F.lit(0.0).alias("log_det"))
    current = stored(whole.withColumn("start", F.lit(0)).unionByName(plain.withColumn("start", F.lit(1))), "starts")
    for _ in range(MAX_STEPS):
        last, current = current, stored(concentrate(rows, current, ["group", "start"]), "concentrated")
        change = F.max(F.abs(F.col("log_det") - F.col("before")))
        before = last.select("group", "start", F.col("log_det").alias("before"))
        if (current.join(before, ["group", "start"]).agg(change).first()[0] or 0.0) <= CONVERGED:
            break
    best = current.groupBy("group").agg(F.min_by(F.struct(*[c for c in current.columns if c not in ("group", "start")]),
                                                 F.struct("log_det", "start")).alias("e"))
    return best.select("group", "e.*")


def rate(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
         keep_columns: list[str] | None = None, tail: float = TAIL) -> DataFrame:
    """The given columns (all of ``docs``) plus the base statistics and ``kept``.

    A null language or source is a group of its own. A group of fewer than
    ``MIN_GROUP`` documents is judged by the estimate of its language, fitted on
    all documents of that language whatever their group; a language of fewer
    than ``MIN_GROUP`` by the estimate of all documents, however few these are:
    the tail probability allows for the size of the core, so that a handful of
    documents rejects none. Null and empty texts fail the word limit. Repeated
    rows are rated alike; an empty table gives an empty table; input columns
    named like a statistic are replaced."""
    names = [c for c in (keep_columns or docs.columns) if c.lower() not in (*BASE, "kept")]
    # the caller's row stays whole in one column, so that its names meet none of ours
    labelled = docs.select(
        F.struct(*["`" + c.replace("`", "``") + "`" for c in names]).alias("_row"), F.col(text).alias("_text"),
        F.to_json(F.struct(F.col(lang).alias("l"))).alias("_language"),
        F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s"))).alias("_group"))
    rated = stored(with_statistics(labelled, "_text").drop("_text"), "quality-statistics")
    passed = rated.where("not base_failed")
    sizes = passed.groupBy("_language", "_group").agg(F.count("*").alias("k"))
    sizes = sizes.withColumn("in_language", F.sum("k").over(Window.partitionBy("_language")))
    levels = F.array(F.concat(F.lit("group "), "_group"), F.concat(F.lit("language "), "_language"), F.lit("all"))
    groups = stored(sizes.select("_group", levels.alias("levels"), F.get(
        levels, F.when(F.col("k") >= MIN_GROUP, 0).when(F.col("in_language") >= MIN_GROUP, 1).otherwise(2)
    ).alias("group")), "quality-groups")
    # a row takes part in each estimate above it by which some group is judged
    fitted = stored(groups.select("_group", F.explode("levels").alias("group")).join(
        groups.select("group").distinct(), "group"), "quality-levels")
    vectors = stored(with_vector(passed.join(fitted, "_group")).select("group", *DIMENSIONS), "quality-vectors")
    core = chi_square_quantile(CORE, P // 2)
    spread = CORE / chi_square(core, P // 2 + 1)  # the core's covariance is too small by this factor
    found = robust_estimates(vectors)
    judged = (with_vector(rated).join(groups.drop("levels"), "_group", "left").join(found, "group", "left"))
    outlier = F.coalesce(tail_probability(distance() / spread, F.col("n")) < tail, F.lit(False))
    return judged.select("_row.*", *BASE, (~F.col("base_failed") & ~outlier).alias("kept"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return rate(docs, keep_columns=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

"""Quality rules whose cutoffs carry a guarantee, in DataFrame functions only.

Each rule rejects a document when one ratio of its text is above a cutoff. Cutoffs come from a fixed grid, and are chosen
per stratum (band of text length) by fixed-sequence testing on labelled rows.

A quarter of the good labelled rows, by a hash of the id, only shapes the sequence: no rule goes below the lowest grid
point that rejects none of them. The sequence starts at the highest cutoff and lowers all rules together, point by point,
each down to its own end. The other labelled rows test it: a step is certified when seeing so few of them rejected by any
rule would have a probability of at most ``delta / strata`` if the rules together rejected more than ``max_false_share``
of the good documents. Testing stops at the first step that is not certified, so the steps of one sequence need no
correction among them, and the strata are corrected for by dividing ``delta``. With confidence ``1 - delta`` the chosen
cutoffs wrongly reject at most ``max_false_share`` of the good documents of every stratum, all rules together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import let, pick, quoted, stored, words_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
}
MIN_WORDS = 50
FEW_HASHES = 32
LEARNING = "0123"  # first digits of the hash of the ids that shape the sequence


@dataclass(frozen=True)
class RiskConfig:
    """``max_false_share``: of the good documents of a stratum, all rules together; ``delta``: chance that this fails
    anywhere; ``grid``: cutoffs in rising order; ``bands``: word counts at which a new stratum begins."""

    max_false_share: float = 0.02
    delta: float = 0.05
    grid: tuple[float, ...] = (
        0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9,
    )
    bands: tuple[int, ...] = (200, 800)

    @property
    def chance_per_test(self) -> float:
        return self.delta / (len(self.bands) + 1)


def repeated_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur twice or more in ``words``, all occurrences counted.

    Hashes of the windows, sorted, show which may repeat; a text without equal hashes has none. The windows behind equal
    hashes are then compared as text: sorted with their places, those equal to a neighbour are kept, and the words under
    them are counted once each from the gaps between the places. With more than ``FEW_HASHES`` equal hashes all windows
    are compared; the count is the same.
    """

    def hashes(w: Column) -> Column:
        of_all = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.slice(of_all, F.lit(1), F.size(w) - 2)

    def equal_hashes(h: Column) -> Column:
        return let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))

    def windows(w: Column, places: Column) -> Column:
        def pair(i: Column) -> Column:
            return F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("text"), i.alias("at"))

        return F.sort_array(F.transform(places, pair))

    def covered(pairs: Column) -> Column:
        def repeated(p: Column, k: Column) -> Column:
            before, after = F.get(pairs, k - 1)["text"], F.get(pairs, k + 1)["text"]
            return F.coalesce(p["text"] == before, F.lit(False)) | F.coalesce(p["text"] == after, F.lit(False))

        starts = F.sort_array(F.transform(F.filter(pairs, repeated), lambda p: p["at"]))
        first = F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last"))
        return F.aggregate(
            starts,
            first,
            lambda s, at: F.struct((s["total"] + F.least(F.lit(3), at - s["last"])).alias("total"), at.alias("last")),
            lambda s: s["total"],
        )

    def compare(w: Column, h: Column, equal: Column) -> Column:
        everywhere = F.sequence(F.lit(0), F.size(w) - 3)
        some = F.filter(everywhere, lambda i: F.array_contains(equal, F.get(h, i)))
        places = F.when(F.size(equal) <= FEW_HASHES, some).otherwise(everywhere)
        return F.when(F.size(equal) == 0, F.lit(0)).otherwise(let(windows(w, places), covered))

    def count(w: Column) -> Column:
        inner = let(hashes(w), lambda h: let(equal_hashes(h), lambda equal: compare(w, h, equal)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(inner)

    return let(words, count)


def text_counts(text: Column) -> Column:
    """Struct of :data:`COUNTS` for one text; null counts as empty, all counts are then 0."""
    text = F.coalesce(text, F.lit(""))

    def count(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).cast("bigint").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        ),
    )

    def hits(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("bigint")

    made = F.struct(
        let(words_of(text), count).alias("words"),
        of_lines.alias("lines"),
        hits(r"[#*$%&|<>]").alias("n_symbols"),
        hits(r"\p{Lu}").alias("n_upper"),
        hits(r"[!?]").alias("n_marks"),
    )
    place = {"n_words": "words", "word_chars": "words", "n_repeat_words": "words", "n_lines": "lines", "n_dup_lines": "lines"}
    return let(made, lambda m: F.struct(*[(m[place[c]][c] if c in place else m[c]).alias(c) for c in COUNTS]))


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a struct column ``_counts`` of :func:`text_counts`.

    The struct comes out of a generator, which the optimizer never copies into the conditions that read it: a text is
    measured once, however many rules ask.
    """
    return df.withColumn("_counts", F.explode(F.array(text_counts(F.col(quoted(text_col))))))


def base_failed(counts: str) -> Column:
    """Too few words, or more than half of them in repeated windows."""
    n, repeats = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeats > 50 * n)


def stratum(counts: str, config: RiskConfig) -> Column:
    """Number of the length band."""
    return sum((F.col(f"{counts}.n_words") >= edge).cast("int") for edge in config.bands) + F.lit(0)


def ratio(counts: str, rule: str) -> Column:
    """Ratio that the rule limits; 0 where its base is 0."""
    top, base = (F.col(f"{counts}.{c}").cast("double") for c in RULES[rule])
    return F.when(base > 0, top / base).otherwise(F.lit(0.0))


def allowed_rejections(n: Column, config: RiskConfig) -> Column:
    """Largest count of false rejections among ``n`` good rows that still certifies a cutoff; -1 if none does.

    Sums the exact binomial probabilities for the share ``max_false_share`` until they pass ``chance_per_test``.
    """
    share = config.max_false_share
    start = F.struct(
        (n * math.log1p(-share)).cast("double").alias("log_p"), F.lit(0.0).alias("sum"), F.lit(-1).cast("bigint").alias("best")
    )

    def step(s: Column, i: Column) -> Column:
        total = s["sum"] + F.exp(s["log_p"])
        following = s["log_p"] + F.log((n - i) / (i + 1)) + math.log(share) - math.log1p(-share)
        best = F.when(total <= config.chance_per_test, i).otherwise(s["best"])
        return F.struct(following.alias("log_p"), total.alias("sum"), best.alias("best"))

    upto = F.floor(n * share).cast("bigint")
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), upto), start, step, lambda s: s["best"])


def certified_cutoffs(rows: DataFrame, labels: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """One row per stratum with labelled rows to test: the certified cutoff of each rule, null where there is none.

    ``rows`` has ``doc_id`` and ``_counts``; ``labels`` has ``doc_id, quality``. Only rows that pass the base rules and
    whose labels all say 1 count as good. Repeated labels count once, null labels not at all. Rows are counted by level
    first, the number of grid points that a ratio is above, so no table here has more than strata x (grid + 1) rows.

    The counts and the cutoffs are stored: expressions over texts make large plans, which the driver optimizes anew whenever
    a part of a query ends. A plan that reads the cutoffs holds none of their making, and labelled texts are measured in one
    pass.
    """
    grid = F.array(*[F.lit(c) for c in config.grid])
    good = pick(labels, doc_id="doc_id", quality="quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = good.filter("quality = 1 and doc_id is not null").select("doc_id")
    held = rows.filter(~base_failed("_counts")).join(good, "doc_id", "semi")

    def level(rule: str) -> Column:
        return let(ratio("_counts", rule), lambda r: F.size(F.filter(grid, lambda cut: r > cut)))

    shaping = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1).isin(*LEARNING)
    levels = held.select(shaping.alias("shaping"), stratum("_counts", config).alias("stratum"), *[level(r).alias(r) for r in RULES])
    counted = stored(levels.groupBy("shaping", "stratum", *RULES).agg(F.count(F.lit(1)).alias("n")), "quality_levels")
    # the grid point at which a rule's sequence ends; there are as many rows as strata
    ends = counted.filter("shaping").groupBy("stratum").agg(*[F.max(r).alias(f"end_{r}") for r in RULES])
    tested = counted.filter("not shaping").join(F.broadcast(ends), "stratum", "left")
    end = {r: F.coalesce(f"end_{r}", F.lit(0)) for r in RULES}
    # the steps below this one reject the row: that of the highest level which a rule's sequence reaches
    before = F.greatest(*[F.when(F.col(r) > end[r], F.col(r)).otherwise(0) for r in RULES])
    by_step = tested.select("stratum", *[end[r].alias(f"end_{r}") for r in RULES], before.alias("before"), "n")
    by_step = by_step.groupBy("stratum", *[f"end_{r}" for r in RULES], "before").agg(F.sum("n").alias("n"))
    per_stratum = by_step.groupBy("stratum", *[f"end_{r}" for r in RULES]).agg(
        F.sum("n").alias("good"), F.map_from_entries(F.collect_list(F.struct("before", "n"))).alias("at")
    )
    steps = len(config.grid)

    def rejected(step: Column) -> Column:
        more = F.sequence(step + 1, F.lit(steps))
        return F.aggregate(more, F.lit(0).cast("bigint"), lambda total, k: total + F.coalesce(F.try_element_at("at", k), F.lit(0)))

    def lowest(allowed: Column) -> Column:  # what a step rejects, all steps below reject, too
        return F.get(F.filter(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: rejected(i) <= allowed), F.lit(0))

    chosen = per_stratum.withColumn("step", let(allowed_rejections(F.col("good"), config), lowest))
    cuts = [F.when(F.col("step").isNotNull(), F.get(grid, F.greatest("step", f"end_{r}"))).alias(f"cut_{r}") for r in RULES]
    return stored(chosen.select("stratum", *cuts), "quality_cutoffs")


def judged(rows: DataFrame, cutoffs: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """``rows`` with booleans ``base_failed`` and ``kept``. The cutoffs have one row per length band: broadcast."""
    bands = F.broadcast(cutoffs.withColumnRenamed("stratum", "_stratum"))
    joined = rows.withColumn("_stratum", stratum("_counts", config)).join(bands, "_stratum", "left")
    over = [F.coalesce(ratio("_counts", r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    rejected = over[0]
    for one in over[1:]:
        rejected = rejected | one
    return (
        joined.withColumn("base_failed", base_failed("_counts"))
        .withColumn("kept", ~F.col("base_failed") & ~rejected)
        .drop("_stratum", *[f"cut_{r}" for r in RULES])
    )


def keep_good(docs: DataFrame, labels: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Labelled rows are measured first to certify the cutoffs, then all rows. Null and empty texts fail the base rules.
    """
    ids = pick(labels, doc_id="doc_id").distinct()
    labelled = pick(docs, doc_id="doc_id", text="text").join(ids, "doc_id", "semi")
    cutoffs = certified_cutoffs(with_counts(labelled).drop("text"), labels, config)
    # the verdict needs few columns; the others travel in one struct, so their names cannot clash
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    kept = judged(with_counts(rows, "_text").drop("_text"), cutoffs, config).filter("kept")
    return kept.select("_row.*")

"""Pages of repeated keywords, link lists or product tags.

Method. The words of each page are counted, and SQL windows turn the counts into a rank-frequency curve, whose slope,
residual and heavy head are fitted, and into a spectrum: the parts of the text that words of a count of 1, 2 to 3, 4 to 7
and so on make up. Links, anchors and tags count as one word that is repeated as often as words fit into their length.
A page is compared with prose of its script and length: pages with enough function words and few heavy words, numbers and
links, whatever else the table holds. Flagged are pages whose curve is extreme (far steeper, or far off its line, or of
another spectrum) while repeated words or links make up much of the text. A curve that is level at a high count has no
slope and no residual; its spectrum tells it. Price lists, contents and glossaries, which repeat words too, are told by
their plain numbers and function words.

Everything is computed inside the JVM. The texts are shuffled once, by page; counts, windows and fits reuse that
partitioning, so no group of a hot word or site is ever gathered.

Defined results: NULL and empty texts are never flagged. A page id that repeats is one page of all its rows' words.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.structure import CONNECT, PLACE
from spanveil.runtime import durable

#: Every loop is possessive and stops where the next link may begin: no recursion, and time linear in the text.
LINK = (
    r"(?is)<a\b[^<>]*+>[^<]*+(?:<(?!/?a\b)[^<]*+)*+</a>|\[[^\]\[\n]*+\]\([^)\s\[]*+\)|(?:https?://|www\.)\S++"
    r"|(?<![\p{L}\p{Nd}_-])(?<![\p{L}\p{Nd}_-]\.)[\p{L}\p{Nd}_-]++(?:\.[\p{L}\p{Nd}_-]++)++/\S*+|#[\p{L}\p{Nd}_]++"
)
TAG = r"<[^<>]++>"
#: Scripts that are compared with their own prose, by the code point of a word's first letter.
SCRIPTS = (("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))), ("greek", ((0x370, 0x3FF),)), ("cyrillic", ((0x400, 0x52F),)), ("arabic", ((0x600, 0x6FF),)), ("han", ((0x3040, 0x9FFF), (0xAC00, 0xD7A3))))
WORD = r"\p{L}+"
#: Function words, and words of amounts, which price lists repeat.
FUNCTION = sorted(CONNECT | PLACE)
AMOUNT = ["руб", "рублей", "рубля", "коп", "тыс", "млн", "шт", "usd", "eur"]
#: A word is heavy from this many times and this share of a page's content words on.
HEAVY_TIMES, HEAVY_SHARE = 4, 0.03
#: Share of a page that links must take to be the greater part.
LINK_PART = 0.5
#: Characters of links that count as one word, and the divergence of the spectrum with them that tells a page of links.
LINK_WORD, LINK_DIVERGENT = 6, 0.3
#: How much steeper than prose of the same length the curve must be, and how steep at least.
STEEPER, STEEP = 0.25, 0.5
#: How much farther off its line than prose the curve must be, and the Jensen-Shannon divergence of its spectrum.
OFF_LINE, DIVERGENT = 0.15, 0.35
#: Classes of the spectrum: word counts by powers of two, the last one open.
SPECTRUM = 10
#: Part of words that occur HEAVY_TIMES, of whatever share: enough in a text of another spectrum, however many keywords.
REPEATED_PART = 0.5
#: Part of heavy words: alone enough; enough if neither function words nor plain numbers hold the text together.
HEAVY_PART, HEAVY_WEAK = 0.4, 0.24
FEW_FUNCTION, FEW_NUMBERS = 0.16, 0.25
#: Part of function words from which a page is made of sentences, though they repeat.
SENTENCE_FUNCTION = 0.28
#: Prose: links and heavy words are under these parts, of so many words at least.
PROSE_LINKS, PROSE_HEAVY, PROSE_WORDS = 0.2, 0.1, 12
#: Weight of prose one class of length away, of prose of the other script, and of each row of CURVE, in pages.
NEARBY, OTHER_SCRIPT, FIXED_WEIGHT = 1 / 64, 0.05, 0.05
#: Slope, residual and spectrum of prose by length class: means of the prose in sf0.1, classes 9 and 10 interpolated.
CURVE = {
    3: (0.0, 0.0, 1.0),
    4: (-0.02, 0.018, 0.983, 0.017),
    5: (-0.047, 0.046, 0.959, 0.041),
    6: (-0.09, 0.091, 0.919, 0.081),
    7: (-0.149, 0.124, 0.853, 0.145, 0.002),
    8: (-0.215, 0.143, 0.771, 0.217, 0.012),
    9: (-0.355, 0.237, 0.526, 0.184, 0.177, 0.102, 0.011),
    10: (-0.496, 0.331, 0.280, 0.151, 0.341, 0.204, 0.024),
    11: (-0.636, 0.425, 0.035, 0.118, 0.506, 0.306, 0.035),
    12: (-0.649, 0.488, 0.033, 0.066, 0.508, 0.356, 0.037),
}


def _solid(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\s+", ""))


def page_curves(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each page with text: link_part, n_words, function_part, number_part, figure_part (numbers and
    words of amounts), slope, residual, heavy_part,
    repeated_part, spectrum (NULL without content words), link_spectrum (with links as a word), script and length class."""
    page = df.where(F.col(text) != "").select(F.col(doc_id).alias("page"), F.col(text).alias("t"))
    # The one shuffle of texts; all that follows is partitioned by page.
    page = page.repartition("page")
    rest = F.regexp_replace(F.regexp_replace("t", LINK, " "), TAG, " ")
    page = page.select("page", _solid(F.col("t")).alias("size"), rest.alias("rest"))
    page = page.select("page", "size", _solid(F.col("rest")).alias("left"), F.regexp_count("rest", F.lit(r"(?<![\p{L}\p{Nd}])\p{Nd}[\p{Nd}.,:/-]*+(?![\p{L}\p{Nd}])")).alias("numbers"), F.lower("rest").alias("rest"))
    words = page.select("page", F.explode_outer(F.regexp_extract_all("rest", F.lit(WORD), F.lit(0))).alias("w"), "size", "left", "numbers")
    counted = words.groupBy("page", "w").agg(F.count("w").alias("n"), F.max("size").alias("size"), F.max("left").alias("left"), F.max("numbers").alias("numbers"))
    function = F.col("w").isin(FUNCTION)
    content = ~function & ~F.col("w").isin(AMOUNT) & (F.length("w") > 2)
    counted = counted.select("page", "n", "size", "left", "numbers", F.coalesce(function, F.lit(False)).alias("function"), F.coalesce(content, F.lit(False)).alias("content"), _script(F.col("w")).alias("script"), F.coalesce(F.col("w").isin(AMOUNT), F.lit(False)).alias("amount"))
    # Words of the same count lie side by side on the curve: one row for each count of a page.
    level = counted.groupBy("page", F.when(F.col("content"), F.col("n")).alias("n")).agg(
        F.count("*").alias("m"), F.max("size").alias("size"), F.max("left").alias("left"), F.max("numbers").alias("numbers"), F.sum("n").alias("all_words"),
        F.sum(F.when(F.col("function"), F.col("n")).otherwise(0)).alias("function_words"), *[F.sum(F.when(F.col("script") == n, F.col("n")).otherwise(0)).alias(f"{n}_words") for n, _ in SCRIPTS],
        F.sum(F.when(F.col("amount"), F.col("n")).otherwise(0)).alias("amount_words"),
    )
    curve = Window.partitionBy("page").orderBy(F.desc_nulls_last("n")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("page")
    k = F.col("n").isNotNull()
    level = level.withColumn("m_here", F.when(k, F.col("m")).otherwise(0)).withColumn("hi", F.sum("m_here").over(curve)).withColumn("lo", F.col("hi") - F.col("m_here"))
    level = level.withColumn("content_words", F.sum(F.when(k, F.col("n") * F.col("m")).otherwise(0)).over(whole))
    y = F.log(F.col("n").cast("double"))
    sx, sxx = _log_sum("hi") - _log_sum("lo"), _log2_sum("hi") - _log2_sum("lo")
    octave = F.least(F.floor(F.log2(F.col("n"))), F.lit(SPECTRUM - 1))
    heavy = k & (F.col("n") >= HEAVY_TIMES) & (F.col("n") >= HEAVY_SHARE * F.col("content_words"))
    fit = level.groupBy("page").agg(
        F.max("size").alias("size"), F.max("left").alias("left"), F.max("numbers").alias("numbers"), F.sum("all_words").alias("n_words"), F.sum("function_words").alias("function_words"),
        *[F.sum(f"{n}_words").alias(f"{n}_words") for n, _ in SCRIPTS], F.sum("amount_words").alias("amount_words"), F.max("content_words").alias("content_words"), F.sum("m_here").cast("double").alias("k"),
        F.sum(F.when(k, sx)).alias("sx"), F.sum(F.when(k, sxx)).alias("sxx"), F.sum(F.when(k, y * F.col("m"))).alias("sy"), F.sum(F.when(k, y * y * F.col("m"))).alias("syy"), F.sum(F.when(k, y * sx)).alias("sxy"),
        F.sum(F.when(heavy, F.col("n") * F.col("m")).otherwise(0)).alias("heavy_words"),
        F.sum(F.when(k & (F.col("n") >= HEAVY_TIMES), F.col("n") * F.col("m")).otherwise(0)).alias("repeated_words"),
        *[F.sum(F.when(k & (octave == i), F.col("n") * F.col("m")).otherwise(0)).alias(f"s{i}") for i in range(SPECTRUM)],
    )
    vxx, vxy, vyy = F.col("k") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("k") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("k") * F.col("syy") - F.col("sy") * F.col("sy")
    fitted = (F.col("k") >= 3) & (vxx > 0)
    one = F.lit(1.0)
    links = F.ceil((F.col("size") - F.col("left")) / LINK_WORD)
    link_octave = F.least(F.floor(F.log2(F.greatest(links, F.lit(1)))), F.lit(SPECTRUM - 1))
    return fit.select(
        "page", F.when(F.col("size") > 0, 1 - F.col("left") / F.col("size")).otherwise(0.0).alias("link_part"), "n_words",
        (F.col("function_words") / F.greatest(F.col("n_words"), one)).alias("function_part"), (F.col("numbers") / F.greatest(F.col("n_words") + F.col("numbers"), one)).alias("number_part"),
        ((F.col("numbers") + F.col("amount_words")) / F.greatest(F.col("n_words") + F.col("numbers"), one)).alias("figure_part"),
        F.when(fitted, vxy / vxx).otherwise(0.0).alias("slope"), F.when(fitted, F.sqrt(F.greatest(vyy - vxy * vxy / vxx, F.lit(0.0))) / F.col("k")).otherwise(0.0).alias("residual"),
        (F.col("heavy_words") / F.greatest(F.col("content_words"), F.lit(1))).alias("heavy_part"), (F.col("repeated_words") / F.greatest(F.col("content_words"), F.lit(1))).alias("repeated_part"),
        F.when(F.col("content_words") > 0, F.array(*[F.col(f"s{i}") / F.col("content_words") for i in range(SPECTRUM)])).alias("spectrum"),
        F.when(F.col("content_words") + links > 0, F.array(*[(F.col(f"s{i}") + F.when(link_octave == i, links).otherwise(0)) / (F.col("content_words") + links) for i in range(SPECTRUM)])).alias("link_spectrum"),
        F.coalesce(*[F.when(2 * F.col(f"{n}_words") > F.col("n_words"), n) for n, _ in SCRIPTS], F.lit("other")).alias("script"), F.floor(F.log2(F.greatest(F.col("n_words"), one))).alias("length_class"),
    )


def _script(word: Column) -> Column:
    first = F.ascii(word)
    inside = lambda ranges: functools.reduce(lambda a, b: a | b, [first.between(lo, hi) for lo, hi in ranges])
    return F.coalesce(*[F.when(inside(ranges), name) for name, ranges in SCRIPTS], F.lit("other"))


def _log_sum(x: str) -> Column:
    """The sum of log r over the ranks up to x, by Stirling's series."""
    v = F.greatest(F.col(x).cast("double"), F.lit(1.0))
    return F.when(F.col(x) <= 1, 0.0).otherwise(v * F.log(v) - v + 0.5 * F.log(v * 6.283185307179586) + 1 / (12 * v))


def _log2_sum(x: str) -> Column:
    """The sum of log r squared over the ranks up to x, by the midpoint integral, set right at rank 1."""
    v = F.greatest(F.col(x).cast("double"), F.lit(1.0)) + 0.5
    at = lambda u: u * F.log(u) * F.log(u) - 2 * u * F.log(u) + 2 * u
    return F.when(F.col(x) <= 1, 0.0).otherwise(at(v) - at(F.lit(1.5)))


def _divergence(a: Column, b: Column) -> Column:
    """Jensen-Shannon divergence of two spectra in bits; 0 where one is missing."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: (part(x, y) + part(y, x)) / 2), F.lit(0.0), lambda s, v: s + v), F.lit(0.0))


def prose_expected(curves: DataFrame) -> DataFrame:
    """Expected slope, residual and spectrum for each script and length class in `curves`, from prose only. The means
    of the prose of each class are smoothed over length: a class weighs by its pages, a neighbour NEARBY times as much
    for each class of distance. Prose of the other script and the fixed CURVE, which weigh little, count where
    there is none nearby. At most two scripts and as many classes as a page length has bits."""
    prose = (F.col("function_part") >= FEW_FUNCTION) & (F.col("number_part") < FEW_NUMBERS) & (F.col("link_part") < PROSE_LINKS) & (F.col("heavy_part") < PROSE_HEAVY) & (F.col("n_words") >= PROSE_WORDS)
    values = ["slope", "residual", *[f"s{i}" for i in range(SPECTRUM)]]
    flat = curves.select("script", "length_class", prose.alias("prose"), "slope", "residual", *[F.col("spectrum")[i].alias(f"s{i}") for i in range(SPECTRUM)])
    known = flat.groupBy("script", "length_class").agg(F.count(F.when(F.col("prose") & F.col("s0").isNotNull(), 1)).cast("double").alias("weight"), *[F.avg(F.when(F.col("prose") & F.col("s0").isNotNull(), F.col(v))).alias(v) for v in values])
    rows = ", ".join(str((c, *v, *[0.0] * (2 + SPECTRUM - len(v)))) for c, v in CURVE.items())
    fixed = curves.sparkSession.sql(f"SELECT CAST(NULL AS string) AS script, CAST(length_class AS bigint) AS length_class, CAST({FIXED_WEIGHT} AS double) AS weight, {', '.join(f'CAST({v} AS double) AS {v}' for v in values)} FROM VALUES {rows} AS t(length_class, {', '.join(values)})")
    source = known.where("weight > 0").unionByName(fixed).withColumnsRenamed({"script": "from_script", "length_class": "from_class"})
    near = F.when(F.col("script") != F.col("from_script"), OTHER_SCRIPT).otherwise(1.0)
    weight = F.col("weight") * near * F.pow(F.lit(NEARBY), F.abs(F.col("length_class") - F.col("from_class")))
    pairs = known.select("script", "length_class").join(F.broadcast(source)).withColumn("w", weight)
    mean = lambda v: F.sum(F.col("w") * F.col(v)) / F.sum("w")
    return pairs.groupBy("script", "length_class").agg(mean("slope").alias("expected"), mean("residual").alias("expected_residual"), F.array(*[mean(f"s{i}") for i in range(SPECTRUM)]).alias("expected_spectrum"))


def judged(curves: DataFrame) -> DataFrame:
    """`curves` with `steeper`, `off_line` and `divergence`, the distances to prose of the same script and length, and
    `stuffed`. The table of expected values has one row for each script and power of two of words, so it may be
    broadcast."""
    expected = prose_expected(curves)
    out = curves.join(F.broadcast(expected), ["script", "length_class"]).withColumn("steeper", F.col("expected") - F.col("slope")).withColumn("off_line", F.col("residual") - F.col("expected_residual"))
    out = out.withColumn("divergence", _divergence(F.col("spectrum"), F.col("expected_spectrum"))).withColumn("link_divergence", _divergence(F.col("link_spectrum"), F.col("expected_spectrum"))).drop("expected_spectrum")
    few_numbers = F.col("number_part") < FEW_NUMBERS
    loose = (F.col("function_part") < FEW_FUNCTION) & few_numbers
    steep = (F.col("slope") <= -STEEP) & (F.col("steeper") >= STEEPER) & (F.col("figure_part") < 2 * FEW_NUMBERS)
    divergent = (F.col("divergence") >= DIVERGENT) & few_numbers
    # Lists of goods with prices and sentences said again and again are off the line of prose, too, so these two ask
    # for few numbers and fewer function words than sentences have.
    keyed = few_numbers & (F.col("function_part") < SENTENCE_FUNCTION)
    extreme = steep | ((F.col("off_line") >= OFF_LINE) | divergent) & keyed
    keywords = extreme & ((F.col("heavy_part") >= HEAVY_PART) | (F.col("heavy_part") >= HEAVY_WEAK) & loose)
    many = divergent & loose & (F.col("repeated_part") >= REPEATED_PART)
    both = extreme & (F.col("link_part") + (1 - F.col("link_part")) * F.col("heavy_part") >= LINK_PART) & loose
    linked = (F.col("link_part") >= LINK_PART) & (F.col("link_divergence") >= LINK_DIVERGENT)
    return out.withColumn("stuffed", linked | keywords | many | both)


def stuffed_pages(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id of the pages that are mostly keywords, links or tags."""
    return judged(durable(page_curves(df, doc_id, text))).where("stuffed").select(F.col("page").alias("doc_id"))

"""Tokens, postings, term statistics, language model, ranking scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queryscope.functions.text import STOP_WORDS, clean, lemma, tokens
from queryscope.sources.shared import MAX_BROADCAST, sendable, stored

#: Fixed weights: zones of a document, components of a score, skipped and reversed pairs.
ZONE_WEIGHT = {"body": 1.0, "title": 2.0, "h1": 1.5}
K1, B = 2.0, 0.75
#: About how many terms a row of a group's usual terms holds.
PIECE = 8192


def all_tokens(zones: DataFrame) -> DataFrame:
    """(doc_id, zone, pos from 1, form, term): every token takes a place, punctuation too."""
    t = zones.select("doc_id", "zone", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    return t.select("doc_id", "zone", (F.col("pos") + 1).alias("pos"), F.lower("token").alias("form"), lemma(F.col("token")).alias("term"))


def postings(zones: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Tokens that are words and whose form and term are no stop words."""
    return all_tokens(zones).where(_word(F.col("form")) & ~F.col("form").isin(*stop_words) & ~F.col("term").isin(*stop_words))


def _word(form: Column) -> Column:
    """Whether a token is a word; other tokens are single characters, so longer ones need no pattern."""
    return (F.length(form) > 1) | form.rlike(r"^[\p{L}\p{N}_]")


def words_freq(zones: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, tf, df) over the postings: occurrences and documents."""
    per_doc = postings(zones, stop_words).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def doc_lengths(posted: DataFrame) -> DataFrame:
    return posted.groupBy("doc_id", "zone").agg(F.count(F.lit(1)).alias("dl"))


@dataclass
class Index:
    """A written positional index: ``postings`` (term, doc_id, zone, pos, form), each file in order of its terms, so that a
    lookup reads the row groups that may hold the term. Everything else is counted from these columns."""

    postings: DataFrame

    @classmethod
    def build(cls, zones: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, path: str | None = None) -> Index:
        """Tokenise each text once and write the postings to ``path`` (by default a fresh one in the shared folder)."""
        rows = postings(zones, stop_words).select("term", "doc_id", "zone", "pos", "form").sortWithinPartitions("term")
        return cls(stored(rows, "postings", path))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """The index that ``build`` wrote to ``path``."""
        return cls(spark.read.parquet(path))

    def entries(self, *terms: str) -> DataFrame:
        """The postings of some terms, by a pushed-down filter."""
        return self.postings.where(F.col("term").isin(*terms))

    def hits(self, terms: DataFrame) -> DataFrame:
        """The postings of the terms of a query table, by a semi join before anything else, written once."""
        wanted = sendable(stored(terms.select("term").distinct(), "terms"))
        return stored(self.postings.join(wanted, "term", "left_semi"), "hits")

    def lengths(self) -> DataFrame:
        """(doc_id, zone, dl)"""
        return doc_lengths(self.postings)

    def vocabulary(self) -> DataFrame:
        """(term, cnt)"""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))

    def document_frequency(self) -> DataFrame:
        """(term, doc_id, n): how often a document holds a term, in all its zones."""
        return self.postings.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def parse_queries(queries: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(query_id, i, term, form) of (query_id, query): cleaned words but stop words and single letters, numbered from 0.

    A query of which nothing is left has no rows, so it scores nothing. Null queries have none.
    """
    words = queries.select("query_id", F.posexplode(F.split(clean(F.col("query")), r"\s+")).alias("at", "form")).withColumn("term", lemma(F.col("form")))
    kept = words.where((F.length("term") > 1) & ~F.col("form").isin(*stop_words) & ~F.col("term").isin(*stop_words))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at")) - 1
    return kept.select("query_id", place.alias("i"), "term", "form")


def language_model(counts: DataFrame) -> DataFrame:
    """(term, cnt, p): expected-likelihood estimate (cnt + 0.5) / (N + 0.5 B) from (term, cnt)."""
    everyone = counts.agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("b"))
    return counts.join(F.broadcast(everyone)).select("term", "cnt", ((F.col("cnt") + 0.5) / (F.col("n") + 0.5 * F.col("b"))).alias("p"))  # one row


def frequency_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(term, cnt) of the lines ``count<TAB>word`` of a frequency list: lemmas, their counts summed; other lines are left out."""
    parts = F.split(F.col(column), "\t")
    rows = lines.select(parts.getItem(0).try_cast("long").alias("cnt"), lemma(F.trim(F.get(parts, F.lit(1)))).alias("term"))
    return rows.where("cnt is not null and term <> ''").groupBy("term").agg(F.sum("cnt").alias("cnt"))


def log_p(p: Column, kind: str = "p_on_topic") -> Column:
    if kind == "p_on_topic":
        return F.abs(F.log(1 - F.exp(-1.5 * p)))
    if kind == "ICF":
        return F.abs(F.log(1 / p))
    raise ValueError(f"unknown kind {kind}")


def weird(freq: DataFrame, model: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` terms most frequent against the model, of (term, tf)."""
    ratio = freq.where(F.col("term") != "").join(model, "term").select("term", F.round(F.col("tf") / F.col("p"), 4).alias("weirdness"))
    return ratio.orderBy(F.desc("weirdness"), "term").limit(top)


def collocations(zones: DataFrame, top: int = 30, window: int = 2, least: int = 2, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The ``top`` word pairs within ``window`` tokens by log-likelihood ratio (a, b, n, g2).

    Words have at least 3 characters and are no stop words; pairs occur ``least`` times. Pairs do not cross texts.
    """
    t = all_tokens(zones).select("doc_id", "pos", F.col("form").alias("w"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    pairs = t
    for k in range(1, window):
        pairs = pairs.withColumn(f"n{k}", F.lead("w", k).over(order))
    pairs = pairs.select(F.col("w").alias("a"), F.explode(F.array(*[f"n{k}" for k in range(1, window)])).alias("b")).where("b is not null")
    both = stored(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
    left, right = both.groupBy("a").agg(F.sum("n").alias("na")), both.groupBy("b").agg(F.sum("n").alias("nb"))
    total = both.agg(F.sum("n").alias("nn"))
    ok = lambda c: (F.length(c) >= 3) & ~F.col(c).isin(*stop_words)
    rows = both.where((F.col("n") >= least) & ok("a") & ok("b")).join(left, "a").join(right, "b").join(F.broadcast(total))  # one row

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    n, na, nb, nn = (F.col(c).cast("double") for c in ("n", "na", "nb", "nn"))
    g2 = 2 * (part(n, na * nb / nn) + part(na - n, na * (nn - nb) / nn) + part(nb - n, (nn - na) * nb / nn) + part(nn - na - nb + n, (nn - na) * (nn - nb) / nn))
    return rows.select("a", "b", "n", F.round(g2, 4).alias("g2")).orderBy(F.desc("g2"), "a", "b").limit(top)


def pair_tf(posted: DataFrame, pairs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(query_id, i, doc_id, zone, tf): for (query_id, i, t0, t1), the weights of t1's places relative to t0's, summed."""
    step = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in weights.items()])).alias("s")
    first = posted.select(F.col("term").alias("t0"), "doc_id", "zone", F.col("pos").alias("p0"))
    second = posted.select(F.col("term").alias("t1"), "doc_id", "zone", F.col("pos").alias("at"))
    left = first.join(pairs, "t0").select("query_id", "i", "t1", "doc_id", "zone", "p0", step).select("query_id", "i", "t1", "doc_id", "zone", (F.col("p0") + F.col("s.k")).alias("at"), F.col("s.w").alias("w"))
    return left.join(second, ["t1", "doc_id", "zone", "at"]).groupBy("query_id", "i", "doc_id", "zone").agg(F.sum("w").alias("tf"))


NEAR = {1: 1.0, -1: 0.5, 2: 0.5}
SKIP = {1: 0.1}


def query_pairs(terms: DataFrame, gap: int) -> DataFrame:
    """Term pairs ``gap`` places apart in each query (query_id, i, term, …)."""
    order = Window.partitionBy("query_id").orderBy("i")
    return terms.select("query_id", "i", F.col("term").alias("t0"), F.lead("term", gap).over(order).alias("t1")).where("t1 is not null")


COMPONENTS = ("w_single", "w_pair", "w_all", "w_phrase", "w_half")


def score_components(index: Index, model: DataFrame, terms: DataFrame, wanted: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """(query_id, doc_id, zone, n and the components of ``wanted``) of zones with a query term.

    ``terms`` is (query_id, i, term, form), i counting from 0; ``model`` is (term, cnt, p). A term that the model lacks
    bears no weight. Only the query terms' postings are read further; pairs are joined for ``w_pair`` alone.
    """
    keys = ["query_id", "doc_id", "zone"]
    hits = index.hits(terms)
    known = model.join(sendable(stored(terms.select("term").distinct(), "terms")), "term", "left_semi").select("term", log_p(F.col("p")).alias("lp"))
    lp = terms.join(known, "term", "left").select("query_id", "i", "term", "form", F.coalesce("lp", F.lit(0.0)).alias("lp"))
    lp = sendable(stored(lp, "weights"))
    n_terms = lp.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    found = hits.withColumnRenamed("form", "own").join(lp, "term").groupBy("query_id", "i", "doc_id", "zone").agg(F.count(F.lit(1)).alias("tf"), F.sum((F.col("own") == F.col("form")).cast("int")).alias("ex"), F.first("lp").alias("lp"))
    per = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("present"), F.sum(F.when(F.col("ex") > 0, 1).otherwise(0)).alias("nonzero"), F.sum("lp").alias("lp_sum"),
        F.sum(F.when(F.col("ex") > 0, F.col("lp")).otherwise(0.0)).alias("lp_exact"), F.sum(F.col("lp") * F.col("ex")).alias("lp_ex"),
        F.min(F.when(F.col("ex") > 0, F.col("tf"))).alias("min_tf"), F.sort_array(F.collect_list("ex"), False).alias("exs"), F.collect_list(F.struct("lp", "tf")).alias("ts"),
    )
    per = per.join(n_terms, "query_id")
    if {"w_single", "w_phrase"} & set(wanted):
        per = per.join(index.lengths(), ["doc_id", "zone"])
    if "w_pair" in wanted:
        per = per.join(_pair_weight(hits, terms, lp, 1, NEAR, "wp1"), keys, "left").join(_pair_weight(hits, terms, lp, 2, SKIP, "wp2"), keys, "left")
    half = F.coalesce(F.get("exs", (F.bround(F.col("n") / 2.0, 0) - 1).cast("int")), F.lit(0))
    forms = {
        "w_single": lambda: F.aggregate("ts", F.lit(0.0), lambda a, t: a + t["lp"] * t["tf"] / (t["tf"] + 1 + F.col("dl") / 350)),
        "w_pair": lambda: F.coalesce("wp1", F.lit(0.0)) + F.coalesce("wp2", F.lit(0.0)),
        "w_all": lambda: F.col("lp_ex") * F.pow(F.lit(0.03), F.col("n") - F.col("present")),
        "w_phrase": lambda: F.when(F.col("present") < F.col("n"), 0.0).otherwise(F.col("lp_sum") * F.least("dl", "min_tf") / (1 + F.least("dl", "min_tf"))),
        "w_half": lambda: F.when(2 * F.col("nonzero") < F.col("n"), 0.0).otherwise(F.col("lp_exact") * half / (1 + half)),
    }
    return per.select(*keys, "n", *[F.round(forms[name](), 6).alias(name) for name in wanted])


def _pair_weight(hits: DataFrame, terms: DataFrame, lp: DataFrame, gap: int, weights: dict[int, float], name: str) -> DataFrame:
    lps = lp.select("query_id", "i", "lp")
    tf = pair_tf(hits, query_pairs(terms, gap), weights).join(lps, ["query_id", "i"])
    tf = tf.join(lps.select("query_id", (F.col("i") - gap).alias("i"), F.col("lp").alias("lp2")), ["query_id", "i"])
    return tf.groupBy("query_id", "doc_id", "zone").agg(F.sum((F.col("lp") + F.col("lp2")) * F.col("tf") / (1 + F.col("tf"))).alias(name))


def scores(index: Index, model: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, zone, score): the weighted components, or ``w_single`` alone for queries of one term."""
    mixed = F.col("w_single") + 0.3 * F.col("w_pair") + 0.1 * F.col("w_all") + 0.2 * F.col("w_phrase") + 0.02 * F.col("w_half")
    score = F.when(F.col("n") == 1, F.col("w_single")).otherwise(mixed)
    return score_components(index, model, terms).select("query_id", "doc_id", "zone", F.round(score, 8).alias("score"))


def total_score(scores: DataFrame) -> DataFrame:
    weight = F.element_at(F.create_map(*[F.lit(x) for z, w in ZONE_WEIGHT.items() for x in (z, w)]), F.col("zone"))
    return scores.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("score") * weight), 9).alias("total"))


def bm25(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, bm25): sum over query terms of ln(total / cf) * 3 tf / (K + tf), K = 2 (0.25 + 0.75 dl / avdl).

    Collection frequencies are counted from the query terms' postings alone; lengths are one row a document.
    """
    hits = index.hits(terms)
    dl = stored(index.postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dl")), "lengths")
    means = dl.agg(F.avg("dl").alias("avdl"), F.sum("dl").alias("total"))
    tf = stored(hits.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf")), "tf")
    cf = tf.groupBy("term").agg(F.sum("tf").alias("cf"))
    asked = terms.select("query_id", "term").distinct()
    rows = tf.join(cf, "term").join(asked, "term").join(dl, "doc_id").join(F.broadcast(means))  # one row
    k = K1 * ((1 - B) + B * F.col("dl") / F.col("avdl"))
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.log(F.col("total") / F.col("cf")) * 3 * F.col("tf") / (k + F.col("tf"))), 5).alias("bm25"))


def common_words(zones: DataFrame, more_than: int = 7, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, n): terms that over ``more_than`` documents hold."""
    return postings(zones, stop_words).groupBy("term").agg(F.countDistinct("doc_id").alias("n")).where(F.col("n") > more_than)


def missing_words(zones: DataFrame, peers: DataFrame, more_than: int = 7, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(doc_id, term): terms that over ``more_than`` documents of a peer group hold and a document of it lacks.

    ``peers`` is (doc_id, grp). What is usual in a group meets a document's own words as lists, in pieces of bounded size,
    so that the rows of the result are made where they are written and never shuffled.
    """
    own = stored(postings(zones, stop_words).select("doc_id", "term").distinct(), "words")
    usual = stored(own.join(peers, "doc_id").groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than).select("grp", "term"), "usual")
    sizes = usual.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    pieces = usual.join(sizes, "grp").groupBy("grp", F.pmod(F.xxhash64("term"), F.col("pieces")).alias("piece")).agg(F.collect_list("term").alias("usual"))
    held = peers.join(own.groupBy("doc_id").agg(F.collect_list("term").alias("held")), "doc_id", "left")
    if usual.count() <= MAX_BROADCAST:
        both = held.join(F.broadcast(pieces), "grp")
    else:
        salts = 8 * zones.sparkSession.sparkContext.defaultParallelism
        salted = pieces.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, ["grp", "salt"])
    lacks = F.array_except("usual", F.coalesce("held", F.array().cast("array<string>")))
    return both.select("doc_id", F.explode(lacks).alias("term"))


def function_words(form: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Whether a token is a stop word or no word at all; parts of speech need a dictionary, which the stop list stands for."""
    return ~_word(form) | form.isin(*stop_words)


def colorize(zones: DataFrame, freq: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(doc_id, pos, form, color, title): stop words and punctuation black, unknown terms red, others the greener the commoner.

    The title is the frequency and the lemma, or the lemma alone.
    """
    known = stored(freq.select("term", "tf"), "frequencies")
    most = known.agg(F.max("tf").alias("most"))
    t = all_tokens(zones).join(sendable(known), "term", "left").join(F.broadcast(most))  # one row
    g = F.round(100 + 155 * F.col("tf") / F.col("most"), 0).cast("int")
    plain = function_words(F.col("form"), stop_words)
    color = F.when(plain, "#010101").when(F.col("tf").isNull(), "#ff0000").otherwise(F.format_string("#%02x%02x00", 255 - g, g))
    title = F.when(plain | F.col("tf").isNull(), F.col("term")).otherwise(F.concat(F.col("tf").cast("string"), F.lit(".0000 "), F.col("term")))
    return t.select("doc_id", "pos", "form", color.alias("color"), title.alias("title"))


def colored_html(colored: DataFrame) -> DataFrame:
    """(doc_id, html): the coloured words of each document in order."""
    word = F.concat(F.lit("<font color = "), F.col("color"), F.lit(" title = "), F.col("title"), F.lit(">"), F.col("form"), F.lit("</font>"))
    rows = colored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))).alias("ws"))
    return rows.select("doc_id", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("html"))


def most_common(freq: DataFrame, top: int = 20, by: str = "df") -> DataFrame:
    """The ``top`` terms of (term, tf, df), ties by term."""
    return freq.orderBy(F.desc(by), "term").limit(top)

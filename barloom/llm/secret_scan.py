"""Secret findings in text, with a random forest that removes false ones.

Everything here is DataFrame, SQL and MLlib work inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import bounded_sample, input_columns
from barloom.session import kept

MIN_LENGTH = 12
#: A word of letters belongs to the dictionary if the corpus has it so often.
DICTIONARY_COUNT = 20
PATH_BUCKETS, NEIGHBOUR_BUCKETS = 8, 32
#: Labelled findings of each class that the forest is grown on.
SAMPLE_PER_CLASS = 10_000
TREES, DEPTH, SEED = 40, 8, 17

# Words that name a credential.
CREDENTIALS = ["token", "password", "passwd", "pwd", "secret", "apikey", "api_key", "key", "auth", "bearer", "credential", "credentials"]
_NAMES = "|".join(sorted(CREDENTIALS, key=len, reverse=True))
# A credential's name at the end of a word, and names with the values given to them.
_LAST_NAME = rf"(?i)(?<![A-Za-z_])({_NAMES})[\"']?[=:]*$"
_GIVEN = rf"(?i)(?<![A-Za-z_])({_NAMES})[\"']?[=:]+(\"[^\"]+\"?|'[^']+'?|[^\s,;\"'=:][^\s,;\"']*)"
_OPEN = rf"(?i)(?<![A-Za-z_])(?:{_NAMES})[\"']?[=:]+([\"'])[^\"']*$"
#: From this mean logarithm on a run's steps are likelier than with 28 equally likely symbols.
READS_AS_WORDS = -3.33
_MAIL = r"[A-Za-z0-9._+\-]@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)+"
_RUN = rf"([A-Za-z0-9+/_\-]{{{MIN_LENGTH},}})"


def dictionary(documents: DataFrame, text: str = "text", least: int = DICTIONARY_COUNT) -> DataFrame:
    """``(word, n)``: words of letters that the whole corpus has at least ``least`` times."""
    words = input_columns(documents, text=text).select(F.explode(F.split("text", r"\s+")).alias("w"))
    plain = words.filter(F.col("w").rlike(r"^\p{L}{3,16}[.,]?$")).select(F.translate(F.lower("w"), ".,", "").alias("word"))
    return plain.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def findings(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``(doc_id, path, word_no, finding, word, neighbour)`` of every run of key characters and every value given to a credential's name.

    Runs have :data:`MIN_LENGTH` characters at least, with digits or without.
    Values have any length and any signs: quoted ones end at their quote, in the
    same word or a later one, others at a space, comma or semicolon; runs inside
    a value are not listed beside it. ``neighbour`` is the word that names the
    run: the one assigned in the same word, or before an assignment sign, or
    simply before.
    """
    rows = input_columns(documents, doc_id=doc_id, text=text, path=path).select("doc_id", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.split("text", r"\s+").alias("ws"))
    words = rows.select("doc_id", "path", "ws", F.posexplode("ws").alias("word_no", "word"))
    before = lambda n: F.coalesce(F.get("ws", F.col("word_no") - n), F.lit(""))
    sign = F.col("word").rlike("[=:]") | before(1).rlike("[=:]$")
    likely = words.filter((F.length("word") >= MIN_LENGTH) & F.col("word").rlike(_RUN) | (F.col("word") != "") & sign)
    named = F.regexp_extract("word", r"([A-Za-z_]{2,})[=:]", 1)
    neighbour = F.when(named != "", named).when(before(1).rlike("^[=:]+$"), before(2)).otherwise(before(1))
    giver = F.when(before(1).rlike("^[=:]+$"), before(2)).when(before(1).rlike("[=:]$") | F.col("word").rlike("^[=:]+[^=:]"), before(1)).otherwise(F.lit(""))
    name = F.regexp_extract(giver, _LAST_NAME, 1)
    whole = F.when(name != "", F.concat(name, F.lit("="), F.regexp_replace("word", "^[=:]+", ""))).otherwise(F.col("word"))
    quote = F.regexp_extract(whole, _OPEN, 1)
    rest = F.array_join(F.slice("ws", F.col("word_no") + 2, F.size("ws")), " ")
    closing = F.when(quote == "", "").when(quote == '"', F.regexp_extract(rest, '^([^"]*")', 1)).otherwise(F.regexp_extract(rest, "^([^']*')", 1))
    likely = likely.withColumn("whole", F.when(closing != "", F.concat(whole, F.lit(" "), closing)).otherwise(whole))
    stripped = lambda v: F.regexp_replace(F.regexp_replace(v, "^[\"']|[\"']$", ""), r"^([A-Za-z0-9+/_\-]+)[.)\]}>]+$", "$1")
    given = F.zip_with(F.regexp_extract_all("whole", F.lit(_GIVEN), 1), F.regexp_extract_all("whole", F.lit(_GIVEN), 2), lambda n, v: F.struct(stripped(v).alias("finding"), F.lower(n).alias("neighbour")))
    likely = likely.withColumn("given", F.filter(given, lambda g: g["finding"] != ""))
    apart = F.filter(F.regexp_extract_all("word", F.lit(_RUN), 1), lambda r: ~F.exists("given", lambda g: F.contains(g["finding"], r)))
    clean = F.lower(F.regexp_replace(neighbour, r"[^\p{L}_]", ""))
    runs = F.transform(apart, lambda r: F.struct(r.alias("finding"), clean.alias("neighbour")))
    return likely.select("doc_id", "path", "word_no", "word", F.explode(F.concat("given", runs)).alias("f")).select("doc_id", "path", "word_no", "word", "f.neighbour", "f.finding")


def _symbols(text: str) -> Column:
    """Letters a-z as they are, every digit as 0, all else as _."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[^a-z0]", "_")


def transitions(words: DataFrame) -> DataFrame:
    """``(pair, logp)``: how likely ordinary words go from one character to the next.

    There are 28 symbols and so at most 784 pairs, which is what may be broadcast.
    """
    spelt = words.select(_symbols("word").alias("s"), "n")
    pairs = spelt.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substr("s", i, F.lit(2)))).alias("pair"), "n")
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("from", F.substring("pair", 1, 1))
    total = counted.groupBy("from").agg(F.sum("n").alias("total"))
    return counted.join(total, "from").select("pair", F.log((F.col("n") + 1) / (F.col("total") + 28)).alias("logp"))


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """Findings with ``coverage``, ``transition`` and the array ``x`` of all features.

    Runs without a digit that are mostly words of the dictionary are left out,
    unless a credential's name stands before them.
    """
    each = found.select("finding").distinct()
    runs = each.select("finding", F.explode(F.regexp_extract_all(F.lower("finding"), F.lit("([a-z]{3,})"), 1)).alias("word"))
    covered = runs.join(words.select("word"), "word").groupBy("finding").agg(F.sum(F.length("word")).alias("covered"))
    steps = each.filter(F.length("finding") > 1).select("finding", F.explode(F.transform(F.sequence(F.lit(1), F.length("finding") - 1), lambda i: F.substr(_symbols("finding"), i, F.lit(2)))).alias("pair")).filter(F.length("pair") == 2)
    walked = steps.join(F.broadcast(transitions(words)), "pair", "left").groupBy("finding").agg(F.avg(F.coalesce("logp", F.lit(-8.0))).alias("transition"))
    size = F.length("finding")
    share = lambda kind: F.regexp_count("finding", F.lit(kind)) / size
    rows = found.join(each.join(covered, "finding", "left").join(walked, "finding", "left"), "finding")
    rows = rows.withColumn("coverage", F.coalesce("covered", F.lit(0)) / size).withColumn("transition", F.coalesce("transition", F.lit(-8.0)))
    rows = rows.filter(F.col("finding").rlike("[0-9]") | F.col("neighbour").isin(CREDENTIALS) | (F.col("coverage") < 0.6))
    hot = lambda c, n: [F.when(F.pmod(F.xxhash64(c), F.lit(n)) == i, 1.0).otherwise(0.0) for i in range(n)]
    numbers = [
        size.cast("double"), F.col("transition"), F.col("coverage"), share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[+/_\\-]"),
        F.size(F.array_distinct(F.split("finding", ""))) / size, F.col("word").rlike(_MAIL).cast("double"), F.col("neighbour").isin(CREDENTIALS).cast("double"),
    ]
    return rows.withColumn("x", F.array(*numbers, *hot("path", PATH_BUCKETS), *hot("neighbour", NEIGHBOUR_BUCKETS))).drop("covered")


def rule_labels() -> Column:
    """Labels of findings whose form speaks for itself; null for all others.

    True: an access key with its fixed prefix, or a value that a credential's
    name is given to. False: a plain number, part of a mail address or link,
    mostly words of the dictionary, or letters that read as words. A word of the
    dictionary after a credential's name may be a password or prose: null.
    """
    named, words, mail = F.col("neighbour").isin(CREDENTIALS), F.col("coverage") >= 0.6, F.col("word").rlike(_MAIL)
    true = F.col("finding").rlike("^AKIA[0-9A-Z]{16}$") | (named & ~F.col("finding").rlike("^[0-9]+$") & (F.col("finding").rlike("[0-9]") | ~words))
    reads = ~F.col("finding").rlike("[0-9]") & (F.col("transition") >= READS_AS_WORDS)
    false = F.col("finding").rlike("^[0-9+/_\\-]+$") | mail | F.col("word").contains("://") | (words | reads) & ~named
    return F.when(true & ~mail, 1).when(false, 0)


@dataclass(frozen=True)
class Remover:
    """Scores findings; without a model every finding is kept."""

    model: RandomForestClassificationModel | None

    def score(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumn("score", F.lit(1.0))
        scored = self.model.transform(rows.withColumn("features", array_to_vector("x")))
        return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def train(labelled: DataFrame, sample: int = SAMPLE_PER_CLASS) -> Remover:
    """Grow the forest on ``(x, label)`` rows, at most ``sample`` of each class by the hash of their features.

    Both classes weigh the same, however many findings they have. With findings
    of one class only there is nothing to tell apart and no model.
    """
    rows = labelled.filter("label IN (0, 1)").select("x", F.col("label").cast("double").alias("label"))
    parts = [bounded_sample(rows.filter(F.col("label") == k), sample, "x") for k in (0, 1)]
    drawn = kept(parts[0].unionByName(parts[1]), "labelled")
    n = {r.label: r["count"] for r in drawn.groupBy("label").count().collect()}
    if len(n) < 2:
        return Remover(None)
    weighed = drawn.withColumn("weight", F.when(F.col("label") == 1, 0.5 * sum(n.values()) / n[1.0]).otherwise(0.5 * sum(n.values()) / n[0.0]))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Remover(forest.fit(weighed.select(array_to_vector("x").alias("features"), "label", "weight")))


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", labels: Column | None = None, learn_from: Column | None = None) -> DataFrame:
    """``(doc_id, word_no, finding, label, score, is_secret)`` of every finding in the whole texts.

    ``labels`` is a condition over the columns of :func:`featured` that gives 1,
    0 or null; :func:`rule_labels` stands in where no labelled findings are at
    hand. ``learn_from`` restricts the rows that teach. Null and empty texts
    have no findings, a null path counts as empty, repeated rows give repeated
    findings, an empty table gives no rows.
    """
    words = kept(dictionary(documents, text), "dictionary")
    rows = kept(featured(findings(documents, doc_id, text, path), words).withColumn("label", rule_labels() if labels is None else labels), "findings")
    remover = train(rows if learn_from is None else rows.filter(learn_from))
    return remover.score(rows).select("doc_id", "word_no", "finding", "label", "score", (F.col("score") >= 0.5).alias("is_secret"))

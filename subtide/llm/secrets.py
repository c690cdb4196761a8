"""Secret scans: a random forest over candidate features removes false positives.

Candidates are long runs of key characters. Features: length, classes and runs of characters, the mean
log-likelihood of the candidate's character transitions, dictionary coverage (share of its three-character
pieces that common words have), path (bits of a hash of the source) and the neighbouring words (what they
name, their lengths and hashes). Transitions and dictionary come from the counts of all words of all
documents; both are tables of a fixed size (36**2 numbers, 36**3 bits). The forest is trained on labelled
findings, at most ``FIT_ROWS`` of each label; every candidate of every text is scored.

Labels come with the findings. Where a corpus has none, ``planted_findings`` makes some: in at most
``FIT_DOCUMENTS`` of its documents, keys of known formats are set between the document's own words as
secrets, and digests, numbers, identifiers, paths and long words as hard negatives, some of them named and
quoted like secrets. The label is what was planted, not a rule over the features.

Defined results: a null text has no candidates; findings of repeated rows repeat; when fewer than two
labels occur, the label decides and an unlabelled candidate counts as a secret; a word before a candidate
that is a candidate itself counts as none; extra columns are ignored, and kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.llm.common import checkpointed

FIT_ROWS, FIT_DOCUMENTS, TREES, DEPTH = 4000, 400, 20, 8
CANDIDATE = "[A-Za-z0-9_+/-]{16,}={0,2}"
_SPACE = "\\s=:\"'`"
#: The last word of what precedes a candidate, with what stands between. Looked for from the end: the first part takes all and gives back.
_BEFORE = f"^(?s:.*)(?<![^{_SPACE}])([^{_SPACE}]++[{_SPACE}]++)$"
KEYWORD = "(?i)(pass(word|wd)?|secret|token|api[_-]?key|access[_-]?key|credential|auth|bearer)"
DIGEST = "(?i)(sha|md5|commit|checksum|digest|hash|etag|uuid|revision|integrity)"
REDACTED = "[SECRET]"
_SYMBOLS, COMMON = "abcdefghijklmnopqrstuvwxyz0123456789", 1e-5
_BUCKETS = 8
FEATURES = ["size", "digits", "uppers", "runs", "distinct", "vowels", "transitions", "coverage", "keyword", "digest", "assigned", "quoted", "before_size", "after_size", *[f"path_{i}" for i in range(4)], *[f"{side}_{i}" for side in ("before", "after") for i in range(_BUCKETS)]]


def language(docs: DataFrame) -> tuple[Column, Column]:
    """Constants from the words of all documents: log-likelihood of each character after another, and a bit for each common three-character piece."""
    n = len(_SYMBOLS)
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("word")).where(F.length("word") < 16).groupBy("word").agg(F.count("*").alias("n"))  # longer ones are candidates themselves
    words = checkpointed(words)
    pairs, threes = (words.select("n", F.explode(_pieces(F.col("word"), width)).alias("piece")) for width in (2, 3))
    two = {r.piece: r.n for r in pairs.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # at most 36**2 rows
    three = [(r.piece, r.n) for r in threes.groupBy("piece").agg(F.sum("n").alias("n")).collect()]  # at most 36**3 rows
    total = [sum(two.get(a * n + b, 0) for b in range(n)) + n for a in range(n)]
    logs = F.lit(" ".join(f"{math.log((two.get(i, 0) + 1) / total[i // n]):.4f}" for i in range(n * n)))
    least, masks = COMMON * sum(k for _, k in three), [0] * (n**3 // 62 + 1)
    for piece, k in three:
        if k >= least:
            masks[piece // 62] |= 1 << piece % 62
    return F.split(logs, " ").cast("array<double>"), F.split(F.lit(" ".join(map(str, masks))), " ").cast("array<bigint>")  # folded once


def _pieces(word: Column, width: int) -> Column:
    """The word's runs of ``width`` symbols as numbers. The array of symbols is bound by a lambda, so that it is made once."""
    n = len(_SYMBOLS)

    def of(c: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(c) - width), lambda i: sum((c[i + k] * n ** (width - 1 - k) for k in range(width)), F.lit(0)))
        return F.when(F.size(c) >= width, runs).otherwise(F.array().cast("array<int>"))

    symbols = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(_SYMBOLS), c) - 1)
    return F.transform(F.array(F.filter(symbols, lambda c: c >= 0)), of)[0]


def candidates(docs: DataFrame, tables: tuple[Column, Column]) -> DataFrame:
    """A row per candidate: doc_id, text_hash, number (in the text), value_sha256 and features."""
    logs, common = tables
    cut = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike(CANDIDATE))
    split = F.struct(F.split("text", CANDIDATE, -1).alias("around"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"))

    def part(around: Column, value: Column, i: Column) -> Column:
        return F.struct(F.regexp_extract(around[i], _BEFORE, 1).alias("tail"), value.alias("value"), F.regexp_extract(around[i + 1], "^\\W*(\\w*)", 1).alias("after"))

    parts = F.transform(F.array(split), lambda s: F.transform(s["values"], lambda v, i: part(s["around"], v, i)))[0]
    cut = cut.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), parts.alias("parts"))  # the text ends here
    cut = cut.select("doc_id", "source", "text_hash", F.posexplode("parts").alias("number", "part")).select("doc_id", "source", "text_hash", "number", "part.*")
    cut = cut.withColumns({"before": F.regexp_extract("tail", f"^([^{_SPACE}]*+)", 1), "between": F.regexp_extract("tail", f"(?s)^[^{_SPACE}]*+(.*)$", 1)})
    size = F.length("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    two, three = (_pieces(F.lower("value"), width) for width in (2, 3))
    likely = F.transform(F.array(two), lambda t: F.aggregate(t, F.lit(0.0), lambda total, p: total + logs[p]) / F.greatest(F.size(t), F.lit(1)))[0]
    bit = lambda p: F.call_function("shiftright", common[F.floor(p / 62).cast("int")], (p % 62).cast("int")).bitwiseAND(F.lit(1))
    known = F.transform(F.array(three), lambda t: F.size(F.filter(t, lambda p: bit(p) == 1)) / F.greatest(F.size(t), F.lit(1)))[0]
    path, before, after = (F.xxhash64(F.lower(c)) for c in ("source", "before", "after"))
    return cut.select(
        "doc_id", "text_hash", "number", F.sha2("value", 256).alias("value_sha256"), size.alias("size"), (F.regexp_count("value", F.lit("[0-9]")) / size).alias("digits"), (F.regexp_count("value", F.lit("[A-Z]")) / size).alias("uppers"),
        (F.length(classes) / size).alias("runs"), (F.size(F.array_distinct(F.split("value", ""))) / size).alias("distinct"), (F.regexp_count("value", F.lit("(?i)[aeiou]")) / size).alias("vowels"),
        likely.alias("transitions"), known.alias("coverage"),
        F.col("before").rlike(KEYWORD).cast("double").alias("keyword"), F.col("before").rlike(DIGEST).cast("double").alias("digest"), F.col("between").rlike("[=:]").cast("double").alias("assigned"), F.col("between").rlike("[\"'`]$").cast("double").alias("quoted"),
        F.length("before").cast("double").alias("before_size"), F.length("after").cast("double").alias("after_size"), *[F.shiftright(path, i).bitwiseAND(F.lit(1)).cast("double").alias(f"path_{i}") for i in range(4)],
        *[(F.pmod(h, F.lit(_BUCKETS)) == i).cast("double").alias(f"{side}_{i}") for side, h in (("before", before), ("after", after)) for i in range(_BUCKETS)],
    )


def planted_findings(docs: DataFrame, tables: tuple[Column, Column], rows: int = FIT_DOCUMENTS, seed: str = "plant") -> DataFrame:
    """Labelled candidates: known secrets and known others between the words of ``rows`` documents, those with the smallest hashes."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    own = docs.select("doc_id", "source", words.alias("words"), F.sha2(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.sha2("text", 256)), 256).alias("h")).where(F.size("words") > 0)
    at = F.pmod(F.xxhash64("h"), F.size("words")).cast("int")
    # Of the hashes below this share there are four times as many as wanted, so few rows of a partition are sent to be sorted.
    share = min(1.0, 4 * rows / max(docs.count(), 1))
    own = own.where(F.col("h") < f"{round(share * 16**12):012x}") if share < 1 else own
    own = own.orderBy("h").limit(rows).select("doc_id", "source", "h", F.slice("words", at + 1, 4).alias("after"), F.slice("words", F.greatest(at - 3, F.lit(1)), F.least(at, F.lit(4))).alias("before"))
    plain = F.coalesce(F.nullif(F.regexp_replace(F.array_join("after", ""), "[^A-Za-z]", ""), F.lit("")), F.lit("word"))
    long_word = F.substring(F.repeat(plain, 16), 1, 24)
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substr(F.lower(F.repeat(plain, 16)), i * 6 + F.lit(1), F.lit(6)))
    h = F.col("h")
    code = F.base64(F.unhex(h))
    cut = lambda c, a, n: F.substring(c, a, n)
    number = cut(F.translate(h, "abcdef", "012345"), 1, 16)
    letters = F.translate(code, "+/=", "k9Z")
    upper_hex = F.upper(F.sha1(h))
    kinds = [
        (1.0, "token = \"", F.sha1(F.concat(h, F.lit("a"))), "\""), (1.0, "TOKEN = \"", upper_hex, "\""), (1.0, "api_key: ", cut(letters, 1, 32), ""), (1.0, "password=", cut(letters, 5, 20), ""), (1.0, "Authorization: Bearer ", code, ""),
        (1.0, "aws ", F.concat(F.lit("AKIA"), F.upper(cut(letters, 3, 16))), ""), (1.0, "", F.concat(F.lit("ghp_"), cut(letters, 1, 36)), ""), (1.0, "secret '", h, "'"),
        (1.0, "password=", cut(h, 1, 18), ""), (1.0, "", F.concat(F.lit("AKIA"), number), ""),
        (0.0, "", long_word, ""), (0.0, "token = \"", long_word, "\""), (0.0, "", number, ""), (0.0, "token ", number, ""), (0.0, "commit ", F.sha1(F.concat(h, F.lit("c"))), ""), (0.0, "sha256 = \"", F.sha2(F.concat(h, F.lit("d")), 256), "\""),
        (0.0, "id: \"", F.concat_ws("-", cut(h, 1, 8), cut(h, 9, 4), cut(h, 13, 4), cut(h, 17, 4), cut(h, 21, 12)), "\""), (0.0, "href ", F.array_join(parts, "/"), ".html"), (0.0, "auth = ", F.array_join(parts, "_"), "()"), (0.0, "", F.array_join(parts, "-"), ""),
    ]
    made = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(head).alias("head"), value.alias("value"), F.lit(tail).alias("tail")) for label, head, value, tail in kinds])
    made = own.select("doc_id", "source", "before", "after", F.posexplode(made).alias("kind", "f"))
    text = F.concat_ws(" ", F.array_join("before", " "), F.concat("f.head", "f.value", "f.tail"), F.array_join("after", " "))
    made = checkpointed(made.select(F.concat_ws(":", F.col("doc_id").cast("string"), "kind").alias("doc_id"), "source", text.alias("text"), "f.label", F.sha2("f.value", 256).alias("planted")))
    facts = made.select("doc_id", F.xxhash64("text").alias("text_hash"), "label", F.col("planted").alias("value_sha256")).distinct()
    return candidates(made, tables).join(facts, ["doc_id", "text_hash", "value_sha256"])


def fit(labelled: DataFrame):
    """The forest of labelled candidates; None with fewer than two labels."""
    order = F.sha2(F.concat_ws(":", "text_hash", "number", "value_sha256"), 256)
    picks = [labelled.where(F.col("label") == label).orderBy(order, F.col("doc_id").cast("string")).limit(FIT_ROWS) for label in (0.0, 1.0)]
    sample = checkpointed(picks[0].unionByName(picks[1]))
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7).fit(_assembler().transform(sample))


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features")


def score(found: DataFrame, forest) -> DataFrame:
    """Candidates with probability and is_secret; without a forest an own ``label`` decides, or every candidate is a secret."""
    if forest is None:
        known = F.coalesce("label", F.lit(1.0)) if "label" in found.columns else F.lit(1.0)
        return found.withColumns({"probability": known, "is_secret": known >= 0.5})
    scored = forest.transform(_assembler().transform(found)).withColumn("probability", F.round(F.element_at(vector_to_array("probability"), 2), 6))
    return scored.withColumn("is_secret", F.col("probability") >= 0.5).drop("features", "rawPrediction", "prediction")


def scan(found: DataFrame) -> DataFrame:
    """Labelled candidates (label may be null) with probability and is_secret."""
    return score(found, fit(found))


def scan_documents(docs: DataFrame) -> DataFrame:
    tables = language(docs)
    return score(candidates(docs, tables), fit(planted_findings(docs, tables)))


def _rebuilt(text: Column, numbers: Column) -> Column:
    around = F.split(text, CANDIDATE, -1)
    values = F.concat(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.array(F.lit("")))
    masked = F.transform(values, lambda v, i: F.when(F.array_contains(numbers, i), F.lit(REDACTED)).otherwise(v))
    return F.array_join(F.zip_with(around, masked, lambda a, b: F.concat(a, b)), "")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in its texts replaced by a mark."""
    hits = scan_documents(docs).where("is_secret").groupBy("doc_id", "text_hash").agg(F.collect_set("number").alias("numbers")).select(F.struct("doc_id", "text_hash", "numbers").alias("hit"))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row.text")
    same = F.col("row.doc_id").eqNullSafe(F.col("hit.doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("hit.text_hash"))
    clean = F.when(F.col("hit").isNull(), text).otherwise(_rebuilt(text, F.col("hit.numbers")))
    return own.join(hits, same, "left").select(*[clean.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op4_secrets(spark, sf_dir) -> DataFrame:
    found = scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "number", "value_sha256", F.col("size").cast("long").alias("size"), "probability", "is_secret")

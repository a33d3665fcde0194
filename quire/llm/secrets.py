"""Secret scans with a random forest against false positives.

Candidates are long runs of key characters, values of known key formats, and
values from ``MIN_ASSIGNED`` characters on that are assigned to a name of
secrets; the name and its ``=`` are no part of a value. Each is described by its
length, its character transitions, how much of it common words cover, its path
(slashes in it, and the name of its source) and its neighbouring words. A
random forest, trained from labelled findings, gives the probability that a
candidate is a secret; the others are removed. A value of a known format stays
and a placeholder goes, whatever the forest says.

Where no labelled findings are at hand, ``weak_labels`` labels the corpus's own
candidates by rules: assigned to a name of secrets or of a known format, or
neither. What the rules read (assignment, format, placeholder) is no feature, so
the forest learns what the values look like and carries that to values without
a name. A candidate without a name may be a secret all the same: those that a
first forest takes for one are no negatives of the second. Training reads at
most ``MAX_TRAINING`` findings of each label, those with the least hash; all
else covers every candidate. All steps are DataFrame functions and Spark ML.

Defined results: null and empty texts have no candidates; a null id is kept;
repeated rows give their findings each; with findings of one label only there
is nothing to learn, and the labels decide; an empty table gives no rows; other
columns are not read. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written

MIN_LENGTH = 20
MIN_ASSIGNED = 8  # of a value assigned to a name of secrets
MAX_TRAINING = 5_000
THRESHOLD = 0.5
TREES, DEPTH, SEED = 20, 6, 7
LEAF = 10  # findings behind a leaf, at most half of the rarer label: a wrong weak label is outvoted by its like
LEFT, RIGHT = 48, 24  # characters of context
MASK = "[SECRET]"

_CLASS = "[A-Za-z0-9_+/-]"
_NAMES = "token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?|signature"
_FORMAT = ("(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|"
           "[rs]k_(?:live|test)_[A-Za-z0-9]{10,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|SG\\.[A-Za-z0-9_-]{16,}\\.[A-Za-z0-9_-]{16,}|"
           "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}")
_GIVEN = f"(?<=(?i:{_NAMES})[A-Za-z0-9_-]{{0,24}}[\"']?\\s{{0,4}}(?:=>|:=|=|:)\\s{{0,4}}"
_BARE = "[^\\s\"'`<>&,;(){}\\[\\]"  # of a value without quotes; closed where it is used
# In this order: a known format, a quoted value of a name, a run of key characters, another value of a name. The short
# look-behinds come first, as few places pass them.
CANDIDATE = (f"(?<!{_CLASS})(?:{_FORMAT})(?!{_CLASS})"
             f"|(?<=[=:>]\\s{{0,4}}[\"'])(?=[^\\s\"']{{{MIN_ASSIGNED}}}){_GIVEN}[\"'])[^\\s\"']++"
             f"|(?<!{_CLASS}){_CLASS}{{{MIN_LENGTH},}}+(?:==(?![A-Za-z0-9_+/=-])|=(?![A-Za-z0-9_+/=\"'-]))?"
             f"|(?<=[=:>]\\s{{0,4}})(?![=:>]){_GIVEN}){_BARE}]{{{MIN_ASSIGNED - 1},}}{_BARE}.:!?]")
_ASSIGNED = f"(?i)(({_NAMES})[A-Za-z0-9_-]*[\"']?\\s*(=>|:=|=|:)\\s*[\"']?|\\bbearer\\s+)$"
_PLACEHOLDER = "(?i)(example|sample|dummy|changeme|placeholder|your[_-]|xxxx|1234567890|abcdefgh|0{8})"
# Words and word parts that prose and identifiers are made of.
_COMMON = ("tion|ing|ent|ion|the|and|for|are|ment|able|ible|ness|ous|ive|ate|ies|ver|ter|her|ther|that|this|with|from|have|was|not|"
           "get|set|new|test|data|file|name|type|list|class|value|index|error|string|number|config|handler|service|manager|"
           "ung|keit|heit|lich|isch|sch|ein|die|der|und|auf|eur|eux|ais|ait|elle|ement|que|les|des|pour|ción|dad|mente|ando|"
           "er|in|on|an|re|ed|nd|ha|at|en|es|or|nt|ea|ti|to|it|st|io|le|is|ou|ar|as|de|rt|ve|th|he")

FEATURES = ["length", "digit_share", "upper_share", "kind_changes", "case_changes", "vowel_changes", "hex_only", "coverage", "slashes", "path_of_tests",
            "left_symbols", "right_symbols", "left_coverage"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``doc_id, tie, path, nth, start, end, value, before, after``: every candidate with its place and surroundings.
    ``tie`` tells rows of one id apart by text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), path.alias("path"), text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", "tie", "path", F.split("text", CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"))
    first = F.slice("gaps", 1, F.size("values"))
    sizes = F.zip_with(first, "values", lambda gap, value: F.length(gap) + F.length(value))
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda sums, size: F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + size)))
    # the text in front of a value, values before it included: each has MIN_ASSIGNED characters or more
    tails = F.zip_with(first, "values", lambda gap, value: F.right(F.concat(F.right(gap, F.lit(LEFT)), F.right(value, F.lit(LEFT))), F.lit(LEFT)))
    near = -(-LEFT // MIN_ASSIGNED)
    before = F.transform(first, lambda gap, k: F.right(F.concat(
        F.array_join(F.slice(tails, F.greatest(k - near, F.lit(0)) + 1, F.least(k, F.lit(near))), ""), F.right(gap, F.lit(LEFT))), F.lit(LEFT)))
    parts = F.arrays_zip(ends.alias("end"), F.col("values").alias("value"), before.alias("before"),
                         F.transform(F.slice("gaps", 2, F.size("values")), lambda gap: F.left(gap, F.lit(RIGHT))).alias("after"))
    rows = rows.select("doc_id", "tie", "path", F.posexplode(parts).alias("nth", "c"))
    return rows.select("doc_id", "tie", "path", "nth", (F.col("c.end") - F.length("c.value")).cast("long").alias("start"), F.col("c.end").cast("long").alias("end"),
                       "c.value", "c.before", "c.after")


def features(found: DataFrame) -> DataFrame:
    """Adds the columns named in ``FEATURES``, and what the rules read: ``assigned``, ``known``, ``placeholder``. The neighbours
    on the left are those in front of the name that a value is assigned to."""
    value, size = F.col("value"), F.length("value")
    left = F.regexp_replace("before", _ASSIGNED, "")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / size

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    return found.withColumns({
        "length": size.cast("double"), "digit_share": share("[0-9]"), "upper_share": share("[A-Z]"),
        "kind_changes": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"), "case_changes": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowel_changes": share("(?i)[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])"),
        "hex_only": flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(value), _COMMON, "")) / size,
        "slashes": share("/"), "path_of_tests": flag(F.col("path").rlike("(?i)(test|example|sample|doc|fixture)")),
        "left_symbols": F.regexp_count(left, F.lit("[^\\p{L}0-9\\s]")) / F.greatest(F.length(left), F.lit(1)),
        "right_symbols": F.regexp_count("after", F.lit("[^\\p{L}0-9\\s\"']")) / F.greatest(F.length("after"), F.lit(1)),
        "left_coverage": 1 - F.length(F.regexp_replace(F.lower(left), _COMMON, "")) / F.greatest(F.length(left), F.lit(1)),
        "assigned": flag(F.col("before").rlike(_ASSIGNED)), "known": flag(value.rlike(f"^({_FORMAT})$")), "placeholder": flag(value.rlike(_PLACEHOLDER)),
    })


def weak_labels(described: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for a candidate assigned to a name of secrets or of a known format that is no placeholder, 0 for any other."""
    return described.withColumn("label", (((F.col("assigned") == 1) | (F.col("known") == 1)) & (F.col("placeholder") == 0)).cast("double"))


def train(labelled: DataFrame, bound: int = MAX_TRAINING, weak: bool = False) -> RandomForestClassificationModel | None:
    """A forest from findings with ``FEATURES`` and ``label``; None unless both labels occur. At most ``bound`` distinct
    findings of each label are read, those whose values and surroundings have the least hash. ``weak``: a label of 0 only says
    that no rule holds, so a second forest learns without those that the first takes for secrets."""
    order = F.xxhash64("value", "before", "after", "path")
    rows = labelled.select(order.alias("order"), "label", *FEATURES)
    both = [rows.where(F.col("label") == k).distinct().orderBy("order", *FEATURES).limit(bound) for k in (0.0, 1.0)]
    sample = both[0].unionByName(both[1]).coalesce(1).sortWithinPartitions("label", "order", *FEATURES)
    # the forest reads its findings many times: once written, none of those scans the texts again
    sample, path = written(sample, "secret-findings")
    try:
        return _fitted(sample, weak)
    finally:
        drop(labelled.sparkSession, path)


def _fitted(sample: DataFrame, weak: bool) -> RandomForestClassificationModel | None:
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(seen) < 2:
        return None
    leaf = max(1, min(LEAF, min(seen.values()) // 2))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, minInstancesPerNode=leaf,
                                    probabilityCol="p")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    model = forest.fit(rows)
    if weak:
        sure = model.transform(rows).where((F.col("label") == 1) | (vector_to_array("p")[1] < THRESHOLD)).select(rows.columns)
        if sure.where("label = 0").limit(1).count():
            model = forest.fit(sure)
    return model


def classify(described: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Adds ``probability`` and ``is_secret``."""
    if model is None:
        return described.withColumn("probability", F.col("label")).withColumn("is_secret", F.col("label") >= THRESHOLD)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described)).withColumn("probability", vector_to_array("p")[1])
    likely = (F.col("probability") >= THRESHOLD) | (F.col("known") == 1)
    return scored.withColumn("is_secret", likely & (F.col("placeholder") == 0)).drop("features", "rawPrediction", "p", "prediction")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", model: RandomForestClassificationModel | None = None) -> DataFrame:
    """Every candidate with its probability. Without ``model``, one is trained from weak labels of these texts."""
    described = weak_labels(features(candidates(docs, id_col, text_col, path_col)))
    return classify(described, model or train(described, weak=True))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with every secret in ``found`` replaced by ``MASK``."""
    secret = found.where("is_secret").groupBy(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_set("nth").alias("_secret"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(-1))).withColumn("_tie", F.xxhash64(text))
    joined = keyed.join(secret, ["_id", "_tie"], "left")
    gaps, values = F.split(F.col(text_col), CANDIDATE, -1), F.regexp_extract_all(F.col(text_col), F.lit(CANDIDATE), F.lit(0))
    shown = F.transform(values, lambda value, nth: F.when(F.array_contains("_secret", nth), F.lit(MASK)).otherwise(value))
    masked = F.array_join(F.zip_with(gaps, shown, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit("")))), "")
    return joined.withColumn(text_col, F.when(F.col("_secret").isNotNull(), masked).otherwise(F.col(text_col))).select(docs.columns)

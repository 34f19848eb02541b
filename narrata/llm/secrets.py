"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate is a value assigned to a telling key (``token = "..."``), a private-key block, a run of 16 or more
token characters with a digit, or one of 24 or more with letters of both cases. Its features are length, transitions between character classes, shares
of classes and of distinct characters, dictionary coverage, whether it stands in a path, and the neighbouring words. A
random forest (JVM library, fixed seed) learns from labelled findings; the fitted trees become one SQL
expression, so that scoring is part of the same projection as the scan and texts are never shuffled.

The default labelled findings are made by rule from a seed (``labelled_findings``); a table (before, value,
after, assigned, secret) can be given in their place. It is the only thing that is fitted, and its size is fixed.

Defined results: a null text has no finding and stays null; an empty text has none; repeated candidates
are findings one by one; a score at the threshold is a secret; rows repeated under one id give their findings each; an empty table gives an empty result; other columns are kept
by ``redact`` and ignored by ``find``. Offsets count code points.
"""

from __future__ import annotations

import json
import random

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrata.llm._work import let

# Keys whose value is taken for a candidate.
KEYS = "token|secret|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|secret[_-]?key|private[_-]?key|auth[_-]?key|client[_-]?secret|credential|bearer"
# Words near a value that speak for and against a secret.
FOR = "token|secret|password|passwd|pwd|key|apikey|auth|bearer|credential|login|private"
AGAINST = "commit|sha|sha1|sha256|md5|hash|checksum|digest|uuid|guid|version|build|isbn|example|sample|placeholder|dummy|card|phone|order|invoice|page|session"
# The dictionary whose coverage of a value is measured.
DICTIONARY = (
    "account admin api app auth authorization blog bucket build change client code com config content data date default demo dev docs download "
    "dummy enter example file fixme foo from github guide here home http https image index insert json key lib local localhost main master "
    "media module name news none null org page passwd password path placeholder please port private prod public readme redacted replace sample script "
    "secret secure server service site some source src static string test text the this todo token undefined user username utils value version web with word "
    "www xxxx your"
).split()
# No candidate is capped: possessive and lazy loops over one character class take no stack and never go back.
_TOK, _TOK_LETTERS, _UNCASED = r"A-Za-z0-9+/_\-", r"A-Za-z+/_\-", r"0-9+/_\-"
_ASSIGN = rf"(?i:(?<![A-Za-z])(?:{KEYS})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)"
_VALUE = r"[^\s\"'<>|&,;]{8,}+"
_BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?>[\s\S]*?(?=-----))-----END [A-Z ]{0,40}PRIVATE KEY-----"
CANDIDATE = rf"{_BLOCK}|{_ASSIGN}{_VALUE}|(?<![{_TOK}])(?:(?=[{_TOK_LETTERS}]*+[0-9])[{_TOK}]{{16,}}+|(?=[A-Z{_UNCASED}]*+[a-z])(?=[a-z{_UNCASED}]*+[A-Z])[{_TOK}]{{24,}}+)={{0,2}}"
MARK = "[SECRET]"
_NEAR = 4  #: words on either side that count as neighbours
FEATURES = ("length", "transitions", "digits", "upper", "lower", "distinct", "dictionary", "path", "assigned", "near_for", "near_against", "hexadecimal")


def _features(before, value, after, assigned) -> dict[str, F.Column]:
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = F.translate(value, lower + upper + digit, "a" * 26 + "A" * 26 + "0" * 10)
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    near = lambda words, x: F.when(F.regexp_like(x, F.lit(rf"(?i)(?<![A-Za-z])(?:{words})(?![a-z])")), 1.0).otherwise(0.0)
    flat = lambda x: F.translate(x, "\t\n\r\x0b\x0c", "     ")
    around = F.concat_ws(" ", F.substring_index(F.rtrim(flat(before)), " ", -_NEAR), F.substring_index(F.ltrim(flat(after)), " ", _NEAR))
    covered = n - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    return {
        "length": n,
        "transitions": F.regexp_count(kinds, F.lit("(?<=a)[^a]|(?<=A)[^A]|(?<=0)[^0]|(?<=[^aA0])[aA0]")) / n,
        "digits": count("[0-9]") / n,
        "upper": count("[A-Z]") / n,
        "lower": count("[a-z]") / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "dictionary": covered / n,
        "path": F.when(F.regexp_like(F.substring_index(flat(before), " ", -1), F.lit(r"://|www\.|[\w.]/")) | F.regexp_like(value, F.lit(r"[a-z]{2,}/[a-z]|\.[a-z]{2,4}$")), 1.0).otherwise(0.0),
        "assigned": F.when(assigned, 1.0).otherwise(0.0),
        "near_for": near(FOR, around),
        "near_against": near(AGAINST, around),
        "hexadecimal": F.when(F.regexp_like(value, F.lit("^[0-9a-fA-F]+$")), 1.0).otherwise(0.0),
    }


def labelled_findings(spark: SparkSession, rows: int = 1600, seed: int = 42) -> DataFrame:
    """Findings with verdicts, half of them secret, made by rule: random values under telling keys or in known
    formats against placeholders, identifiers, digests, numbers and paths."""
    r = random.Random(seed)
    pick = lambda alphabet, lo, hi: "".join(r.choice(alphabet) for _ in range(r.randint(lo, hi)))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: r.choice(["token", "secret", "password", "api_key", "access_key", "client_secret"])
    word = lambda: pick("etaoinshrdlu", 2, 9)

    def secret():
        kind, k = r.randrange(8), key()
        k = k.upper() if r.random() < 0.3 else k
        if kind == 0:
            v = pick(hexa, 32, 64)
            return k, v.upper() if r.random() < 0.4 else v, True
        if kind == 1:
            return k, pick(alnum + "+/_-", 20, 64), True
        if kind == 2:
            return k, "".join(r.choice(alnum + "!#%@*.") for _ in range(r.randint(10, 24))), True
        if kind == 3:
            return "key", r.choice(["AKIA", "ASIA"]) + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), False
        if kind == 4:
            return "auth", r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + pick(alnum, 24, 40), False
        if kind == 5:
            return k, r.choice(["", "-", "_"]).join(pick("abcdefghijklmnoprstuvw", 4, 8) for _ in range(r.randint(2, 4))), True  # a passphrase
        if kind == 6:
            return r.choice([k, word()]), pick(alnum[:52], 24, 48), False
        return "bearer", pick(alnum + "-_", 32, 80), False

    def benign():
        kind = r.randrange(11)
        if kind == 0:
            return key(), r.choice(["your_token_here", "xxxxxxxxxxxx", "placeholder", "changeme1234", "example_password", "<redacted>", "undefined", "test_secret_value", "replace_this_key", "insert-your-api-key"]), True
        if kind == 1:
            return r.choice(["commit", "sha1", "checksum", "md5", "hash", "digest"]), pick(hexa, 32, 64), False
        if kind == 2:
            return r.choice(["uuid", "guid", word()]), "-".join(pick(hexa, n, n) for n in (8, 4, 4, 4, 12)), False
        if kind == 3:
            return r.choice(["card", word(), word()]), pick("0123456789", 16, 19), False
        if kind == 4:
            return "https://www.example.org", "/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + "/" + pick("0123456789", 1, 4), False
        if kind == 5:
            return word(), "-".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + pick("0123456789", 1, 3), False
        if kind == 6:
            return word(), pick("etaoinshrdlu", 16, 30) + pick("0123456789", 1, 2), False
        if kind == 7:
            return key(), r.choice(["settings.", "os.environ.", "config."]) + r.choice(DICTIONARY) + "_" + r.choice(DICTIONARY), True
        if kind == 8:
            return word(), "".join(r.choice(DICTIONARY).capitalize() for _ in range(r.randint(5, 9))), False
        if kind == 9:
            return word(), "/".join(r.choice(DICTIONARY).capitalize() for _ in range(r.randint(4, 7))), False
        return word(), f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}-{r.choice(DICTIONARY)}-{r.choice(DICTIONARY)}", False

    made = []
    for i in range(rows):
        k, v, assigned = secret() if i % 2 == 0 else benign()
        lead = " ".join(word() for _ in range(3))
        glue = r.choice([" = \"", ": ", "=", " = '"]) if assigned else r.choice([" ", ": ", " = "]) if "://" not in k else "/"
        made.append((lead + " " + k + glue, v, r.choice(["\" ", " ", "' ", ".\n"]) + word(), assigned, float(i % 2 == 0)))
    rows = [dict(zip(("before", "value", "after", "assigned", "secret"), m, strict=True)) for m in made]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<before: string, value: string, after: string, assigned: boolean, secret: double>>")))


def fit(findings: DataFrame, trees: int = 12, depth: int = 6, seed: int = 7) -> dict:
    """Random forest over the findings: {"trees": [nested nodes]}; a leaf is a share of secrets, a node (feature, threshold, left, right)."""
    got = findings.select(F.col("secret").alias("label"), *[c.alias(k) for k, c in _features(F.col("before"), F.col("value"), F.col("after"), F.col("assigned")).items()])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(got).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)

    def node(x):
        if x.subtreeDepth() == 0:
            stats = list(x.impurityStats().stats())
            return (stats[1] + 0.5) / (stats[0] + stats[1] + 1.0)
        split = x.split()
        return FEATURES[split.featureIndex()], split.threshold(), node(x.leftChild()), node(x.rightChild())

    return {"trees": [node(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees]}


def _tree(node, features) -> F.Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    name, threshold, left, right = node
    return F.when(features[name] <= threshold, _tree(left, features)).otherwise(_tree(right, features))


def score(model: dict, features) -> F.Column:
    """Mean of the trees; ``features`` is a struct column."""
    total = F.lit(0.0)
    for t in model["trees"]:
        total = total + _tree(t, features)
    return total / float(len(model["trees"]))


def _hits(text, model) -> F.Column:
    """array<struct<gap, hit, value, kind, lead, score>> of a text, null where there is none."""
    gaps, hits = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1))

    def judged(gaps, hits):
        def one(hit, i):
            gap, nxt = F.get(gaps, i), F.get(gaps, i + 1)
            lead = F.length(F.regexp_extract(hit, f"^({_ASSIGN})", 1))
            block = F.startswith(hit, F.lit("-----BEGIN"))
            assigned = lead > 0
            value = F.when(assigned, F.substring(hit, lead + 1, F.length(hit))).otherwise(hit)
            before = F.concat(gap, F.when(assigned, F.substring(hit, F.lit(1), lead)).otherwise(F.lit("")))
            made = let(F.struct(value.alias("value"), before.alias("before"), nxt.alias("after"), assigned.alias("assigned")), lambda x: F.struct(*[c.alias(k) for k, c in _features(x["before"], x["value"], x["after"], x["assigned"]).items()]))
            points = F.when(block, F.lit(1.0)).otherwise(let(made, lambda f: score(model, f)))
            kind = F.when(block, F.lit("private_key")).when(assigned, F.lit("assigned")).otherwise(F.lit("run"))
            return F.struct(gap.alias("gap"), hit.alias("hit"), kind.alias("kind"), lead.alias("lead"), points.alias("score"))

        return F.transform(hits, one)

    return let(F.struct(gaps.alias("gaps"), hits.alias("hits")), lambda x: F.struct(judged(x["gaps"], x["hits"]).alias("found"), F.element_at(x["gaps"], -1).alias("tail")))


def find(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, start, length, value, kind, score, secret), one row a candidate."""
    held = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), _hits(F.col(text_col), model).alias("h"))
    rows = held.select("id", "row", F.posexplode("h.found").alias("k", "f")).select("id", "row", "k", "f.*")
    rows = rows.select("id", "row", "k", F.length("gap").alias("g"), "hit", "kind", "lead", "score")
    run = W.partitionBy("row").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("g") + F.length("hit")).over(run), F.lit(0)) + F.col("g") + F.col("lead"))
    return rows.select(
        "id", F.col("start").cast("long").alias("start"), (F.length("hit") - F.col("lead")).cast("long").alias("length"),
        F.substring("hit", F.col("lead") + 1, F.length("hit")).alias("value"), "kind", "score", (F.col("score") >= threshold).alias("secret"),
    )


def redact(docs: DataFrame, model: dict, text_col: str = "text", n_chars_col: str | None = "n_chars", threshold: float = 0.5, mark: str = MARK) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; the column of text lengths, where there is one, follows."""
    def put(x):
        each = F.transform(x["found"], lambda f: F.concat(f["gap"], F.when(f["score"] >= threshold, F.concat(F.substring(f["hit"], F.lit(1), f["lead"]), F.lit(mark))).otherwise(f["hit"])))
        return F.concat(F.concat_ws("", each), x["tail"])

    text = F.col(text_col)
    clean = F.when(F.regexp_like(text, F.lit(CANDIDATE)), let(_hits(text, model), put)).otherwise(text)
    out = docs.withColumn(text_col, clean)
    if n_chars_col and n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col(n_chars_col)).cast(docs.schema[n_chars_col].dataType))
    return out

"""Secret scans: candidates by pattern, a random forest against false positives, compiled into expressions.

Candidates are assignments to names such as token or password, read to the closing quote where there is one on the
line, and long runs of letters and digits with a digit, also right after the '=' of any other name. Each gets features of its length, of character transitions, of how much of it a dictionary covers, of its
likeness to a path and its document's path, and of the neighbouring words. The forest is trained here on labelled
findings (``labelled_findings()`` makes a seeded set; another can be passed), whose features come from the
same expressions, and its trees become nested conditions. Scanning is one projection of built-in functions.

Offsets count code points from 0. Null and empty texts have no findings; a null path is an empty one. Repeated rows are
scanned each; an empty table gives no rows. Whole texts are scanned, in time linear in the text and its candidates.
The neighbourhood of a candidate is the ``AROUND`` characters before it and the 8 after it, as far as the next candidates.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

NAME = r"(?=[acpstACPST])(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?"
TO_VALUE = NAME + r"(?:[_-][A-Za-z0-9]{1,40}+){0,8}+[\"']?\s{0,3}[:=]\s{0,3}"
LEAD = TO_VALUE + r"[\"']?(?=[\s\S])"
RUN = r"[A-Za-z0-9+/_-]"
# to the closing quote: one word, or words without a run that may be a secret of its own
QUOTED = "|".join(rf"{q}(?:[^{q}\\\s]|\\\S){{6,}}+(?={q})|{q}(?![^{q}\r\n]*{RUN}{{16}})(?:[^{q}\\\r\n]|\\.){{6,}}+(?={q})" for q in "\"'")
# to a space, quote or separator, or to the next parameter of a query string
BARE = r"[\"']?(?:[^\s\"',;<>&]|&(?![\w.-]{1,40}=)){6,}+"
CANDIDATE = rf"{TO_VALUE}(?:{QUOTED}|{BARE})|(?<!{RUN})(?={RUN}{{16}})(?=[A-Za-z+/_-]*+[0-9]){RUN}{{16,}}(?:={{1,2}}(?![A-Za-z0-9+/=_-]))?"
AROUND = 48

# Common words of prose and of programs; parts of names and paths that say something about a candidate.
DICTIONARY = (
    "example sample dummy changeme placeholder your here test demo default value string name user admin password secret token key "
    "file path image data index main config version release build commit order item page section chapter number license public general "
    "the and for with that this from have not are was will can all one time year work world hand part place case week company system "
    "about after again also because before between both come could day each even every first get give good great group high into just know "
    "last life like little long look make many more most much must need new next number old only other our out over own people point "
    "problem right same see seem should show since small some state still such take than their them then there these they thing think "
    "through under until very want water way well what when where which while who why without word would write "
    "account action address client code color column content count create current database date delete description document element email "
    "error event field filter format function header height icon info input item length level link list local log login map message method "
    "model module node note object option output package parent password product project property query record request response result role "
    "root route schema script search select server service session setting size source start status string style table target task template "
    "title total type update upload url user uuid value view width window"
).split()
HINTS = "token|secret|passw|pwd|passphrase|api.?key|access.?key|auth|bearer|credential|private"
BENIGN = "commit|sha|hash|checksum|digest|uuid|guid|version|isbn|phone|card|order|invoice|example|sample|etag|revision|image|png|page"
TEST_PATH = "test|example|fixture|sample|mock|doc"
CONFIG_PATH = r"\.(?:env|ini|cfg|conf|ya?ml|toml|json|properties|pem|tf)$|(?:^|/)(?:conf|config|deploy|settings|secrets?)(?:/|$)"

FEATURES = (
    "length", "class_changes", "letter_digit", "case_changes", "vowel_turns", "digit_share", "upper_share", "sign_share", "hexadecimal", "distinct_share",
    "dictionary_share", "slashes", "extension", "test_path", "config_path", "path_depth", "hinted", "benign", "assigned", "quoted", "repeats",
)


def _share(value: Column, pattern: str) -> Column:
    """Share of the characters that are parts of matches."""
    return F.lit(1.0) - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    small = F.lower(before)

    def count(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern))

    def has(text: Column, pattern: str) -> Column:
        return text.rlike(pattern).cast("double")

    changes = count("[a-z](?=[^a-z])") + count("[A-Z](?=[^A-Z])") + count("[0-9](?=[^0-9])")
    found = {
        "length": F.length(value),
        "class_changes": changes / F.length(value),
        "letter_digit": (count("[A-Za-z](?=[0-9])") + count("[0-9](?=[A-Za-z])")) / F.length(value),
        "case_changes": (count("[a-z](?=[A-Z])") + count("[A-Z](?=[a-z])")) / F.length(value),
        "vowel_turns": count("(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])") / F.length(value),
        "digit_share": _share(value, "[0-9]"),
        "upper_share": _share(value, "[A-Z]"),
        "sign_share": _share(value, "[^A-Za-z0-9]"),
        "hexadecimal": has(value, "^[0-9a-fA-F-]+$"),
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "dictionary_share": _share(value, "(?i)" + "|".join(w for w in DICTIONARY if len(w) > 2)),
        "slashes": count("/"),
        "extension": has(value, r"\.[A-Za-z]{2,4}$|^[\w/-]+/[\w-]+$"),
        "test_path": has(F.lower(path), TEST_PATH),
        "config_path": has(F.lower(path), CONFIG_PATH),
        "path_depth": F.regexp_count(path, F.lit("/")),
        "hinted": has(small, HINTS),
        "benign": has(small, BENIGN),
        "assigned": has(before, r"[:=]\s{0,3}[\"']?$"),
        "quoted": has(before, "[\"'`]$") * has(after, "^[\"'`]"),
        "repeats": count(r"(.)(?=\1)") / F.length(value),
    }
    return {n: F.coalesce(found[n].cast("double"), F.lit(0.0)) for n in FEATURES}


def labelled_findings(seed: int = 11, rounds: int = 90) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label) of findings as reviewers mark them, from a seeded generator."""
    draw = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, word = dig + "abcdef", low + up + dig

    def of(alphabet: str, n: int) -> str:
        return "".join(draw.choice(alphabet) for _ in range(n))

    def name() -> str:
        return draw.choice(["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "passwd", "credential"])

    def lead() -> str:
        return draw.choice(["", "the ", "let ", "export ", "in the text "]) + name() + draw.choice([" = \"", "=", ": ", "='", "\": \""])

    def plain() -> str:
        return " ".join(draw.choice(DICTIONARY) for _ in range(4)) + " "

    rows = []
    for _ in range(rounds):
        path = draw.choice(["src0", "src7", "app/main", "conf", "web", "deploy/prod.env", "settings.yml"])
        fake = draw.choice(["src3", "tests/fixture", "docs/example", "src1", "web/static/index.html"])
        secrets = [
            (of(hexa, draw.choice([32, 40, 64])), lead()), (of(word, draw.randint(20, 48)), lead()), ("AKIA" + of(up + dig, 16), draw.choice([lead(), plain()])),
            ("ghp_" + of(word, 36), draw.choice([lead(), plain()])), ("sk_live_" + of(word, 24), draw.choice([lead(), plain()])), ("eyJ" + of(word, 40) + "_" + of(word, 30), draw.choice([lead(), "Bearer "])),
            (of(word + "!#$%", draw.randint(9, 16)), lead()), (of(word + "+/", 40) + "==", lead()),
        ]
        rows += [(v, b, '"' if b[-1] in "\"'" else " ", path, 1) for v, b in secrets]
        words = [draw.choice(DICTIONARY) for _ in range(4)]
        others = [
            ("-".join([of(hexa, 8), of(hexa, 4), of(hexa, 4), of(hexa, 4), of(hexa, 12)]), draw.choice(["id ", "uuid: ", plain()])), (of(hexa, 40), draw.choice(["commit ", "revision ", "sha1 hash "])),
            (of(hexa, 64), draw.choice(["sha256 checksum: ", "digest ", "etag="])), (of(dig, draw.choice([16, 19])), draw.choice(["card ", "order ", plain(), "number "])),
            ("/".join(words) + of(dig, 2) + ".png", plain()), ("_".join(words) + of(dig, 2), plain()), ("".join(w.title() for w in words) + of(dig, 1), plain()),
            (draw.choice(["your_token_here_1", "changeme123", "example_secret_key_0", "xxxxxxxxxxxxxxxx1", "placeholder-value-123", "00000000000000000000", "password", "default"]), lead()),
            (words[0] + "." + words[1] + "()", name() + " = "), (of(dig, 20), plain()), ("v" + "_".join(of(dig, 2) for _ in range(6)), "version "),
        ]
        rows += [(v, b, " ", draw.choice([path, fake]), 0) for v, b in others]
    draw = random.Random(seed + 1)  # values glued to other names, in query strings and with any sign in quotes
    for _ in range(rounds):
        path = draw.choice(["src0", "src7", "app/main", "conf", "web", "deploy/prod.env", "settings.yml"])

        def env(names: str) -> str:
            return draw.choice(["", "export ", "ENV ", plain()]) + draw.choice(names.split()) + "="

        def link(names: str) -> str:
            return draw.choice(["https://", plain()]) + ".".join(draw.sample(DICTIONARY, 2)) + "/" + draw.choice(DICTIONARY) + draw.choice("?&") + draw.choice(names.split()) + "="

        keys, plain_names = "GITHUB_PAT STRIPE_SK AWS_ID DEPLOY_PAT SIGNING_SK BOT_KEY NPM_PAT SK KEY", "COMMIT BUILD_SHA IMAGE_DIGEST RELEASE ETAG ORDER_ID TRACE_UUID PAGE"
        known = draw.choice(["AKIA" + of(up + dig, 16), "ghp_" + of(word, 36), "sk_live_" + of(word, 24)])
        signed, quote = of(word + "!#$%,;<>&", draw.randint(8, 18)), draw.choice("\"'")
        words = [draw.choice(DICTIONARY) for _ in range(draw.randint(2, 9))]
        mine = [
            (known, env(keys), "\n", 1), (known, env("AWS_ACCESS_KEY_ID ACCESS_KEY_ID API_KEY_V2 CI_TOKEN_MAIN"), "\n", 1), (of(word, draw.randint(24, 44)), env(keys), "\n", 1), (of(word, draw.randint(20, 44)), link("sig key sk signature code"), draw.choice("& "), 1),
            (signed, name() + draw.choice([" = ", "=", ": "]) + quote, quote, 1),
            (of(hexa, draw.choice([40, 64])), env(plain_names), "\n", 0), ("-".join(of(hexa, n) for n in (8, 4, 4, 4, 12)), link("id uuid item ref"), "&", 0), (of(dig, draw.choice([16, 18, 20])), link("page order id item"), " ", 0),
            ("_".join(words[:4]) + "_" + of(dig, 2), env("NAME FILE MODE TITLE") if draw.random() < 0.5 else link("name file title"), " ", 0), (" ".join(words) + draw.choice(["", ".", "?", ", " + words[0]]), name() + draw.choice([" = ", "=", ": "]) + quote, quote, 0),
            (draw.choice([of(dig, 6), "-".join(words[:2]) + "-name", "_".join(words[:2])]), name() + draw.choice(["_count", "_name", "_field", "-type"]) + draw.choice([" = ", "=", ": "]), " ", 0),
        ]
        rows += [(v, b, a, path, label) for v, b, a, label in mine]
    return rows


def grow_tree(x: np.ndarray, y: np.ndarray, draw: np.random.RandomState, depth: int, per_split: int):
    """(feature, threshold, low, high) nodes over leaves that hold the share of secrets."""
    if depth == 0 or len(y) < 6 or y.min() == y.max():
        return (y.sum() + 0.5) / (len(y) + 1.0)
    best = None
    for k in draw.choice(x.shape[1], per_split, replace=False):
        order = np.argsort(x[:, k], kind="stable")
        ranked, hits = x[order, k], np.concatenate([[0], np.cumsum(y[order])])
        values = np.unique(ranked)
        cuts = (values[1:] + values[:-1]) / 2 if len(values) <= 24 else np.quantile(ranked, np.linspace(0.04, 0.96, 24))
        n = np.searchsorted(ranked, cuts, "right")
        m = len(y) - n
        fit = (n >= 2) & (m >= 2)
        if not fit.any():
            continue
        cuts, n, m = cuts[fit], n[fit], m[fit]
        p, q = hits[n] / n, (hits[-1] - hits[n]) / m
        loss = n * p * (1 - p) + m * q * (1 - q)
        at = int(loss.argmin())
        if best is None or loss[at] < best[0]:
            best = loss[at], k, float(cuts[at])
    if best is None:
        return (y.sum() + 0.5) / (len(y) + 1.0)
    _, k, cut = best
    low = x[:, k] <= cut
    return k, cut, grow_tree(x[low], y[low], draw, depth - 1, per_split), grow_tree(x[~low], y[~low], draw, depth - 1, per_split)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 6, seed: int = 5) -> list:
    draw = np.random.RandomState(seed)
    forest = []
    for _ in range(trees):
        rows = draw.randint(0, len(y), len(y))
        forest.append(grow_tree(x[rows], y[rows], draw, depth, 6))
    return forest


def compile_forest(forest: list, row: str = "") -> str:
    """Mean vote as nested conditions, in SQL, on the features of a row or of a struct (``row`` then ends in a dot)."""

    def branch(node) -> str:
        if not isinstance(node, tuple):
            return f"{float(node)!r}D"
        k, cut, low, high = node
        return f"CASE WHEN {row}{FEATURES[k]} <= {float(cut)!r}D THEN {branch(low)} ELSE {branch(high)} END"

    return f"({' + '.join(map(branch, forest))}) / {len(forest)}"


_grown: list = []


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None) -> list:
    """The forest of some labelled findings; that of the built-in ones, always the same, is grown once a session."""
    if findings is None and _grown:
        return _grown
    rows = spark.createDataFrame(findings or labelled_findings(), "value string, before string, after string, path string, label int")
    values = features(F.col("value"), F.col("before"), F.col("after"), F.col("path"))
    table = np.array([tuple(r) for r in rows.select(*[values[n].alias(n) for n in FEATURES], "label").collect()], dtype=float)
    forest = grow_forest(table[:, :-1], table[:, -1])
    if findings is None:
        _grown.extend(forest)
    return forest


CHUNK = 512
FOUND = "array<struct<start: int, size: int, value: string, before: string, after: string>>"


def _running(lengths: str) -> Column:
    """Sums of all earlier elements of an array of ints: those of whole chunks, then those inside each.

    ``array_append`` copies its array, so one walk over n elements would copy n squared of them. One-element
    transforms bind an array to a name, so that it is made once and not for every element.
    """
    walk = "aggregate({}, named_struct('at', {}, 'out', cast(array() AS array<int>)), (a, x) -> named_struct('at', a.at + x, 'out', array_append(a.out, a.at)), a -> a.out)"
    chunks = f"transform(array({lengths}), l -> transform(sequence(0, (size(l) - 1) div {CHUNK}), i -> slice(l, i * {CHUNK} + 1, {CHUNK})))[0]"
    starts = walk.format("transform(c, x -> aggregate(x, 0, (t, y) -> t + y))", "0")
    return F.expr(f"transform(array({chunks}), c -> flatten(zip_with(c, {starts}, (p, o) -> {walk.format('p', 'o')})))[0]")


def _with_candidates(rows: DataFrame) -> DataFrame:
    """Add to rows of (text, ...) ``pieces`` (gap, head, whole) of every candidate in order, the text after the last one
    as ``tail``, and ``found`` (start, size, value, before, after). Each step is linear in the text and its candidates."""
    rows = rows.withColumn("wholes", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    rows = rows.withColumn("gaps", F.when(F.size("wholes") > 0, F.split("text", CANDIDATE, -1)))
    rows = rows.withColumns({"gap": F.slice("gaps", 1, F.size("wholes")), "next": F.slice("gaps", 2, F.size("wholes")), "tail": F.element_at("gaps", -1)})
    pieces = F.transform(
        F.arrays_zip("wholes", "gap", "next"),
        lambda p: F.struct(p["wholes"].alias("whole"), F.regexp_extract(p["wholes"], "^" + LEAD, 0).alias("head"), p["gap"].alias("gap"), F.substr(p["next"], F.lit(1), F.lit(8)).alias("after")),
    )
    rows = rows.withColumn("pieces", pieces).drop("wholes", "gaps", "gap", "next")
    rows = rows.withColumn("starts", _running("transform(pieces, p -> length(p.gap) + length(p.whole))"))

    def described(p: Column, at: Column) -> Column:
        value = F.substr(p["whole"], F.length(p["head"]) + 1)
        before = F.right(F.concat(F.right(p["gap"], F.lit(AROUND)), p["head"]), F.lit(AROUND))
        return F.struct((at + F.length(p["gap"]) + F.length(p["head"])).alias("start"), F.length(value).alias("size"), value.alias("value"), before.alias("before"), p["after"].alias("after"))

    return rows.withColumn("found", F.zip_with("pieces", "starts", described)).drop("starts")


def _measured(found: Column, path: Column) -> Column:
    """(start, size, value, features) of every candidate of an array."""

    def measured(f: Column) -> Column:
        return F.struct(f["start"], f["size"], f["value"], *[c.alias(n) for n, c in features(f["value"], f["before"], f["after"], path).items()])

    return F.transform(found, measured)


def _scored(measured: str, forest: list, threshold: float) -> Column:
    scored = f"transform({measured}, f -> named_struct('start', f.start, 'size', f.size, 'value', f.value, 'score', {compile_forest(forest, 'f.')}))"
    return F.expr(f"transform({scored}, f -> named_struct('start', f.start, 'size', f.size, 'value', f.value, 'score', f.score, 'is_secret', f.score >= {float(threshold)!r}D))")


def _path(path_col: str) -> Column:
    return F.coalesce(F.col(path_col).cast("string"), F.lit(""))


def find_secrets(docs: DataFrame, forest: list, text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """Add ``findings``: array of (start, size, value, score, is_secret), null when there is no candidate; a column of that name gives way."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _path(path_col).alias("path"))
    rows = _with_candidates(rows).withColumn("found", _measured(F.col("found"), F.col("path"))).withColumn("findings", _scored("found", forest, threshold))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "findings"], "findings")


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, its number in the text, start, size, SHA-256 of the value, score, is_secret."""
    forest = train(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _path(path_col).alias("path"))
    # candidates become rows before they are judged; of a bare column, a filter on its size would be inferred and make it twice
    rows = _with_candidates(rows).select("doc_id", "path", F.posexplode(F.coalesce("found", F.array().cast(FOUND))).alias("candidate", "f"))
    rows = rows.select("doc_id", "candidate", "path", "f.*")
    rows = rows.select("doc_id", "candidate", "start", "size", "value", *[c.alias(n) for n, c in features(F.col("value"), F.col("before"), F.col("after"), F.col("path")).items()])
    rows = rows.select("doc_id", "candidate", "start", "size", "value", F.expr(compile_forest(forest)).alias("score"))
    return rows.select("doc_id", "candidate", "start", "size", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))


def redact_documents(docs: DataFrame, mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """All rows and columns; confirmed secrets in ``text`` give way to a mark and ``n_chars`` follows."""
    columns = docs.columns
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"), _path("source").alias("path"))
    rows = _with_candidates(rows).withColumn("found", _measured(F.col("found"), F.col("path"))).withColumn("findings", _scored("found", train(docs.sparkSession), threshold))
    rows = rows.withColumn("secret", F.exists("findings", lambda f: f["is_secret"]))
    parts = F.zip_with("pieces", "findings", lambda p, f: F.concat(p["gap"], F.when(f["is_secret"], F.concat(p["head"], F.lit(mark))).otherwise(p["whole"])))
    rows = rows.withColumn("clean", F.when(F.col("secret"), F.concat(F.array_join(parts, ""), F.col("tail"))).otherwise(F.col("row.text")))
    kept = {"text": F.col("clean")}
    if "n_chars" in columns:
        kept["n_chars"] = F.when(F.col("secret"), F.length("clean").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return rows.select(*[kept.get(c, F.col("row")[c]).alias(c) for c in columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, sf_dir, "documents"))

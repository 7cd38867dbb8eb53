"""Secret scan: candidates by pattern, false positives removed by a random forest.

A pattern finds candidates (long runs of token characters with a digit, values
after a password cue in any case, private keys with their bodies). Each is
described by its length, character classes and transitions, the share that
dictionary fragments cover, whether it is part of a path, and the neighbouring
words. A random forest, trained on the driver from a bounded set of labelled
findings, scores it; the trees become CASE expressions, so documents are scanned
by SQL functions only, in one pass and without a shuffle.

The text is split by the pattern into gaps and matches; places are sums of their
lengths, so a span is where the pattern matched, whatever else the text holds.

Labelled findings: ``labelled_findings`` makes TRAIN_ROWS of them from a seed
(token formats, hashes, identifiers, paths and words in typical contexts), as
the tables carry no labels for findings. Pass others to ``train``.

Defined results: a null or empty text has no candidates; whole texts and values
of any length are read; rows that repeat are scanned each; doc_id may be null; an
empty table gives no rows; ``redact`` keeps further columns whatever their names.
"""

from __future__ import annotations

import random
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import read_table

#: Labelled findings the forest is trained on, at most.
TRAIN_ROWS, SEED = 4000, 61
TREES, MAX_DEPTH, MIN_LEAF = 15, 7, 5
CUTOFF = 0.5
MASK = "[SECRET]"
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]{0,20000}+(?:-(?!----)[^-]{0,20000}+){0,8}+-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
    r"|(?i:password|passwd|pwd|passphrase|secret)[\x22']?[ \t]{0,3}[:=][ \t]{0,3}[\x22']?[^\s\x22']{8,}+"
    r"|[A-Za-z0-9_+/-]{16,}+(?:\.[A-Za-z0-9_-]{10,}+){0,2}={0,2}"
)
FRAGMENTS = "the|and|ing|ion|ent|for|test|data|file|name|user|page|image|index|config|class|value|type|http|www|com|org|node|java|python|module|version|release|build|main|master|static|public|lib|src|docs|path"
GOOD = r"(?i)(key|token|secret|passw|pwd|auth|bearer|credential|access|api)"
BAD = r"(?i)(sha-?\d|md5|commit|checksum|digest|uuid|guid|etag|hash|revision|integrity|example|sample|dummy|placeholder|build id|order|invoice|tracking|isbn|id=|session)"
PREFIX = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[baprs]-|sk_live_|sk_test_|sk-|AIza|eyJ|npm_|SG\.|-----BEGIN)"
FEATURES = ("len", "digits", "uppers", "kinds", "turns", "distinct", "dict", "hex", "uuid", "path", "assigned", "quoted", "good", "bad", "prefix", "vowels")


def _features(c: str, before: str, after: str) -> str:
    """SQL for the feature struct of candidate ``c`` between ``before`` and ``after``."""
    n = f"greatest(length({c}), 1)"
    classes = f"translate(translate(translate({c}, '{string.ascii_lowercase}', '{'a' * 26}'), '{string.ascii_uppercase}', '{'A' * 26}'), '{string.digits}', '{'0' * 10}')"
    share = lambda what: f"length(regexp_replace({c}, '[^{what}]', '')) / {n}"
    flag = lambda test: f"cast({test} as double)"
    parts = {
        "len": f"cast(length({c}) as double)",
        "digits": share("0-9"),
        "uppers": share("A-Z"),
        "kinds": flag(f"{c} rlike '[a-z]'") + f" + cast({c} rlike '[A-Z]' as double) + cast({c} rlike '[0-9]' as double)",
        "turns": f"(length(regexp_replace({classes}, '(.)\\\\1+', '$1')) - 1) / {n}",
        "distinct": f"size(array_distinct(split({c}, ''))) / {n}",
        "dict": f"1 - length(regexp_replace(lower({c}), '{FRAGMENTS}', '')) / {n}",
        "hex": flag(f"{c} rlike '^([0-9a-f]+|[0-9A-F]+)$'"),
        "uuid": flag(f"{c} rlike '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$'"),
        "path": flag(f"({c} rlike '/.*/' and not {c} rlike '[+=]') or {before} rlike '[/.@]$' or {after} rlike '^[/]|^[.][a-z]{{2,4}}'"),
        "assigned": flag(f"{before} rlike '[:=][ \\\\t]*[\\\\x22\\']?$' or {c} rlike '[:=]'"),
        "quoted": flag(f"{before} rlike '[\\\\x22\\']$'"),
        "good": flag(f"{before} rlike '{_sql(GOOD)}' or {c} rlike '^(?i)(passw|pwd|passphrase|secret)'"),
        "bad": flag(f"{before} rlike '{_sql(BAD)}'"),
        "prefix": flag(f"{c} rlike '{_sql(PREFIX)}'"),
        "vowels": share("aeiouAEIOU"),
    }
    return ", ".join(f"cast({parts[f]} as double) as {f}" for f in FEATURES)


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def labelled_findings(n: int = TRAIN_ROWS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(candidate, before, after, label) from a seed: half secrets, half look-alikes."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    word = lambda: "".join(r.choice(("the", "ion", "er", "an", "ou", "st", "re", "en", "data", "ing", "ber", "le", "que", "co", "mo")) for _ in range(r.randint(1, 4)))
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 5)))
    cues = ("token", "api_key", "apikey", "secret", "access_token", "auth", "API_KEY", "client_secret", "aws_secret_access_key", "bearer", "credential", "private key")
    innocent = ("commit", "sha256", "md5", "checksum", "uuid", "etag", "build id", "order", "hash", "revision", "digest", "session", "isbn", "tracking")
    out = []
    while len(out) < n:
        secret = (
            lambda: pick(hexes, r.choice((32, 40, 48, 64))),
            lambda: pick(alnum, r.randint(20, 64)),
            lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
            lambda: r.choice(("ghp_", "gho_")) + pick(alnum, 36),
            lambda: "sk_live_" + pick(alnum, 24),
            lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24),
            lambda: "AIza" + pick(alnum + "-_", 35),
            lambda: "eyJ" + pick(alnum, 20) + ".eyJ" + pick(alnum, 40) + "." + pick(alnum + "-_", 43),
            lambda: pick(alnum + "+/", 40),
            lambda: "-----BEGIN RSA PRIVATE KEY-----" + r.choice(("", "\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(r.randint(1, 26))) + "\n-----END RSA PRIVATE KEY-----")),
        )
        kind = r.randrange(len(secret))
        c = secret[kind]()
        if kind < 2 or kind == 8 or r.random() < 0.5:
            before = f"{prose()} {r.choice(cues)}{r.choice((' = ', '=', ': ', ':'))}{r.choice(('', chr(34), chr(39), chr(34)))}"
        else:
            before = prose() + r.choice((" ", "\n", ' "'))
        out.append((c, before[-60:], r.choice(('"', "'", " ", "\n", "")) + prose(), 1))
        if r.random() < 0.1:
            c = f"{r.choice(('password', 'Password', 'PASSWORD', 'passwd', 'pwd', 'secret', 'SECRET'))}{r.choice((' = ', '=', ': '))}{pick(alnum + '!@#%', r.choice((8, 10, 12, 16, 20, 40, 90)))}"
            out.append((c, prose() + r.choice((" ", " DB_", " my", "\n")), " " + prose(), 1))
        other = (
            lambda: (pick(hexes, r.choice((32, 40, 64))), f"{prose()} {r.choice(innocent)}{r.choice((' ', ': ', '=', ' = '))}"),
            lambda: (f"{pick(hexes, 8)}-{pick(hexes, 4)}-{pick(hexes, 4)}-{pick(hexes, 4)}-{pick(hexes, 12)}", prose() + r.choice((" ", " id=", " request ", ": "))),
            lambda: ("/".join(word() for _ in range(r.randint(3, 6))) + str(r.randint(0, 99)), prose() + r.choice((" ", " /", " https://"))),
            lambda: ("-".join(word() for _ in range(r.randint(3, 6))) + f"-{r.randint(1, 2024)}", prose() + " "),
            lambda: (pick(string.digits, r.randint(16, 22)), prose() + r.choice((" ", " order ", " +", ": "))),
            lambda: ("_".join(word() for _ in range(r.randint(3, 6))) + str(r.randint(0, 9)), prose() + r.choice((" ", " = ", "("))),
            lambda: (word() + word() + word() + word() + str(r.randint(0, 99)), prose() + " "),
            lambda: (f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-00", prose() + " "),
            lambda: (pick("xX0", r.randint(16, 32)), f"{r.choice(cues)}="),
            lambda: (f"password: {r.choice(('********', 'xxxxxxxx', 'changeme', 'required', '<your-password>', '${PASSWORD}'))}", prose() + " "),
            lambda: (pick(hexes, 40), prose() + r.choice((" ", " at ", " see "))),
        )
        c, before = other[r.randrange(len(other))]()
        out.append((c, before[-60:], r.choice((" ", "\n", ".", ".html", "/", "")) + prose(), 0))
    return out[:n]


def train(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, seed: int = SEED) -> list:
    """A forest of (feature, threshold, left, right) nodes with leaf probabilities."""
    rng = np.random.default_rng(seed)
    width = max(1, int(np.sqrt(rows.shape[1])) + 1)

    def grow(at: np.ndarray, depth: int):
        y = labels[at]
        if depth == MAX_DEPTH or len(at) < 2 * MIN_LEAF or y.min() == y.max():
            return round(float(y.mean()), 4)
        best = None
        for f in rng.choice(rows.shape[1], width, replace=False):
            x = rows[at, f]
            for t in np.unique(np.quantile(x, np.linspace(0.05, 0.95, 19))):
                left = x <= t
                n = int(left.sum())
                if n < MIN_LEAF or len(at) - n < MIN_LEAF:
                    continue
                p, q = y[left].mean(), y[~left].mean()
                impurity = n * p * (1 - p) + (len(at) - n) * q * (1 - q)
                if best is None or impurity < best[0]:
                    best = (impurity, int(f), float(t), left)
        if best is None:
            return round(float(y.mean()), 4)
        _, f, t, left = best
        return (f, t, grow(at[left], depth + 1), grow(at[~left], depth + 1))

    return [grow(rng.integers(0, len(rows), len(rows)), 0) for _ in range(trees)]


def tree_sql(node, var: str) -> str:
    if isinstance(node, float):
        return f"{node}D"
    f, t, left, right = node
    return f"(CASE WHEN {var}.{FEATURES[f]} <= {t!r}D THEN {tree_sql(left, var)} ELSE {tree_sql(right, var)} END)"


def forest_sql(forest: list, var: str) -> str:
    return f"({' + '.join(tree_sql(t, var) for t in forest)}) / {len(forest)}"


def featured(spark: SparkSession, findings: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of labelled findings by the same SQL that scans documents; as many rows as ``findings``."""
    rows = spark.createDataFrame(findings, "c string, b string, a string, label int").selectExpr(f"struct({_features('c', 'b', 'a')}) as f", "label").collect()
    return np.array([[r["f"][k] for k in FEATURES] for r in rows]), np.array([r["label"] for r in rows], float)


_TRAINED: dict[int, list] = {}


def forest_of(spark: SparkSession) -> list:
    if SEED not in _TRAINED:
        _TRAINED[SEED] = train(*featured(spark, labelled_findings()))
    return _TRAINED[SEED]


@lru_cache
def _pattern() -> str:
    return _sql(CANDIDATE)


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _examined(forest: list, body: str, none: str) -> str:
    """SQL over the column ``text``: ``body``, in which t.m are the matches, t.g the gaps around them and s the scores (null: no candidate); ``none`` where nothing matches."""
    before = "right(concat(IF(i > 0, concat(right(t.g[i - 1], 60), t.m[i - 1]), ''), t.g[i]), 60)"
    after = "left(concat(t.g[i + 1], IF(i + 1 < size(t.m), t.m[i + 1], '')), 12)"
    around = f"transform(t.m, (c, i) -> IF(c rlike '[0-9]' or c rlike '^-----' or c rlike '[:=]', struct(c as c, {before} as b, {after} as a), null))"
    described = f"transform({around}, p -> IF(p is null, null, struct({_features('p.c', 'p.b', 'p.a')})))"
    scores = f"transform({described}, x -> IF(x is null, null, {forest_sql(forest, 'x')}))"
    split = f"struct(regexp_extract_all(text, '{_pattern()}', 0) as m, split(text, '{_pattern()}', -1) as g)"
    return f"CASE WHEN text is null or not text rlike '{_pattern()}' THEN {none} ELSE {_let(split, 't', _let(scores, 's', body))} END"


#: SQL: end of match i: lengths are summed in blocks of 256, as many matches would else be summed each from the start.
_ENDS = (
    "element_at(transform(array(transform(t.m, (c, i) -> length(t.g[i]) + length(c))), l -> element_at(transform(array("
    "transform(sequence(0, (size(l) - 1) div 256), b -> aggregate(slice(l, 1, int(b * 256)), 0, (x, y) -> x + y))), "
    "h -> transform(l, (n, i) -> h[int(i div 256)] + aggregate(slice(l, int(i div 256) * 256 + 1, i % 256 + 1), 0, (x, y) -> x + y))), 1)), 1)"
)
_REDACTED = f"array_join(transform(t.g, (g, i) -> concat(g, IF(i < size(t.m), IF(s[i] >= {CUTOFF}, '{MASK}', t.m[i]), ''))), '')"


def scan(docs: DataFrame, forest: list | None = None) -> DataFrame:
    """One row per document: n_candidates, n_secrets, spans (start:end, from 0, end exclusive), top_score, redacted_sha256."""
    forest = forest or forest_of(docs.sparkSession)
    secret = f"filter(transform(s, (v, i) -> IF(v >= {CUTOFF}, i, null)), i -> i is not null)"
    spans = _let(_ENDS, "e", _let(secret, "k", "array_join(transform(k, i -> concat(e[i] - length(t.m[i]), ':', e[i])), ',')"))
    body = f"struct(cast(size(filter(s, v -> v is not null)) as long) as n_candidates, cast(size({secret}) as long) as n_secrets, IF(size({secret}) = 0, '', {spans}) as spans, round(coalesce(array_max(s), 0D), 6) as top_score, {_REDACTED} as redacted)"
    none = "struct(0L as n_candidates, 0L as n_secrets, '' as spans, 0D as top_score, coalesce(text, '') as redacted)"
    found = docs.select("doc_id", F.expr(_examined(forest, body, none)).alias("_s"))
    return found.select("doc_id", "_s.n_candidates", "_s.n_secrets", "_s.spans", "_s.top_score", F.sha2("_s.redacted", 256).alias("redacted_sha256"))


def redact(docs: DataFrame, forest: list | None = None) -> DataFrame:
    """``docs`` with secrets masked in ``text``; no document is dropped."""
    forest = forest or forest_of(docs.sparkSession)
    return docs.withColumn("text", F.expr(_examined(forest, _REDACTED, "text")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))

"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are assignments to a name that says secret (any white space beside the sign, a
value on the next line, in quotes with whatever stands in them, or behind Bearer, Basic or
Digest), passwords in addresses (//user:password@), private-key blocks, tokens of a known
form and long runs of key characters that hold a digit, of any length. No candidates are
values of fewer than 8 characters, unquoted values beyond their first blank, comma, quote,
semicolon or angle bracket, and names with more than 32 characters behind the word that
says secret. A whole private-key block is a secret whatever its body is made of. Each gets
features of its length, its character transitions (the mean log-odds of its pairs of
neighbouring characters in secrets against others, learned from labelled findings), how
much of it common words cover, whether it looks like part of a path, and the words beside
it. A random forest, trained in numpy from labelled findings, gives the probability that
it is a secret; the trained trees are compiled into one expression, so scanning is a single
pass of DataFrame functions over the texts, without a shuffle.

A text is cut once into its candidates and what stands between them. What is beside a
candidate comes from the few pieces next to it, and places are sums over those before, so
the cost grows with the text and with the number of candidates, not with its square.

Labelled findings are a small table (before, value, after, label); labelled_findings()
makes the one shipped with the library. Its size (FINDINGS) does not follow the data. The
transitions are learned from half of it and the forest from the other half.

Defined cases: a null or empty text has no findings and stays as it is; repeated rows
give repeated findings; candidates do not overlap, the leftmost wins; an empty table
gives an empty result; other columns are ignored by the scan and kept by redact.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.text import let, sums_before

TREES = 15
DEPTH = 6
FINDINGS = 3200
SECRET = 0.5
#: Characters beside a candidate that its features see, and pieces of text that surely hold so many.
BESIDE = 48
PIECES = 6
MASK = "[SECRET]"

# What names a secret, what names something harmless, and common filler words.
NAMING = "api[_-]?key|access[_-]?key|secret|token|passwd|password|pwd|credential|bearer|auth|private[_-]?key|client[_-]?secret"
HARMLESS = "commit|revision|checksum|digest|sha-?1|sha-?256|md5|hash|uuid|guid|etag|version|build|order|invoice|isbn|phone|card|ticket|tracking|image|file|path|href|src|http"
WORDS = (
    "example|sample|test|dummy|placeholder|changeme|change|your|here|password|secret|token|insert|replace|default|undefined|none|null|true|false|user|name|value|config|index|version|release|module|service|controller|"
    "manager|handler|factory|component|request|response|session|database|table|column|function|method|class|object|string|number|image|file|path|page|post|article|content|update|create|delete|build|assets|static|"
    "public|private|local|server|client|admin|data|time|date|year|month|week|this|that|with|from|have|and|the|for"
)

# The start of tokens that are known by their form; they may stand behind any sign.
KNOWN = (
    r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|[rs]k_(?:live|test)_[A-Za-z0-9]{10,}|"
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|hooks\.slack\.com/services/[A-Za-z0-9/]{16,})"
    r"|(?<![A-Za-z0-9_-])(?:sk-(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{16,}(?:\.[A-Za-z0-9_-]{16,}){2})"
)
# Whole key blocks of any length, with header lines where there are any.
BLOCK = (
    r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----(?:\s|\\[nr])*+(?:[A-Za-z][A-Za-z-]*+: [^\r\n\\]*+(?:[\r\n]|\\[nr])++)*+"
    r"[A-Za-z0-9+/=\\\s]*+-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
)
SIGN = r"[\"']?[ \t]*+[:=][ \t]*+(?:\r?\n[ \t]*+)?(?:(?i:bearer|basic|digest)[ \t]++)?"
NAMED = rf"(?i:{NAMING})[A-Za-z0-9_-]{{0,32}}+{SIGN}"
KEYED = rf"{NAMED}(?:[\"']?{BLOCK}|\"[^\"\r\n]{{8,}}+(?=\")|'[^'\r\n]{{8,}}+(?=')|[\"']?[^\s\"',;<>]{{8,}})"
# User and password of an address.
USER = r"[^\s/:@\"'<>]*+:"
LOGIN = rf"(?<=://){USER}[^\s/@\"'<>]{{8,}}+(?=@)"
# What comes before the value of a candidate that has a name.
NAME = rf"^(?:{NAMED}[\"']?(?=[^\r\n]{{8}})|{USER}(?=[^\s/@\"'<>]{{8,}}+$))"
# A run that is the name of an assignment leaves its place to KEYED.
RUN = rf"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Za-z0-9+/_-]{{16}})(?![A-Za-z0-9_-]*?{NAMED}[^\s\"',;<>]{{8}})[A-Za-z0-9+/_-]{{16,}}+(?:\.[A-Za-z0-9_-]{{16,}}+){{0,2}}={{0,2}}"
CANDIDATE = f"{BLOCK}|{LOGIN}|{KEYED}|{KNOWN}|{RUN}"

#: Letters, a digit and any other sign: what transitions are counted between.
SIGNS_TOLD = 28
FEATURES = ("length", "digits", "uppers", "class_changes", "case_changes", "transitions", "distinct", "hex_only", "digits_only", "covered", "slashes", "blanks", "path_before", "dashes", "named", "harmless", "harmless_after", "block", "known")


def pair_codes(value: Column) -> Column:
    """array<int>: a number below SIGNS_TOLD squared for each pair of neighbouring characters."""
    code = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("0", "9"), 26).otherwise(27)
    codes = F.transform(F.filter(F.split(F.lower(value), ""), lambda c: c != ""), code)
    return let(codes, lambda k: F.transform(F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))), lambda c, i: F.get(k, i) * SIGNS_TOLD + c))


def features(before: Column, value: Column, after: Column, odds: np.ndarray) -> list[Column]:
    """The doubles of FEATURES, in their order; odds is the log-odds of each pair (see transitions)."""
    low = F.lower(value)
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    table = F.array(*[F.lit(float(x)) for x in odds])
    odd = let(pair_codes(value), lambda k: F.aggregate(k, F.lit(0.0), lambda a, c: a + F.get(table, c)) / F.greatest(F.size(k), F.lit(1)))
    return [
        F.least(n, F.lit(256.0)),
        count(value, "[0-9]") / n,
        count(value, "[A-Z]") / n,
        count(value, "(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]") / n,
        count(value, "(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]") / n,
        odd,
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
        flag(value.rlike("^[0-9a-fA-F]+$")),
        flag(value.rlike("^[0-9_-]+$")),
        1 - F.length(F.regexp_replace(low, WORDS, "")) / n,
        count(value, "/") / n,
        count(value, " ") / n,
        flag(before.rlike(r"[/\\.#?&-]$|://\S*$")),
        count(value, "[_-]") / n,
        flag(before.rlike(rf"(?i)(?:{NAMING})[A-Za-z0-9_-]{{0,32}}\S{{0,8}}\s{{0,3}}\S{{0,3}}\s{{0,3}}(?:(?:bearer|basic|digest)\s+)?[\"']?$|://{USER}$")),
        flag(before.rlike(rf"(?i)\b(?:{HARMLESS})")),
        flag(after.rlike(rf"(?i)^\W{{0,4}}(?:{HARMLESS})")),
        flag(value.startswith("-----BEGIN")),
        flag(value.rlike(KNOWN)),
    ]


# How the labelled findings name a secret, and the signs behind the name.
NAMES = ("token", "secret", "api_key", "API-KEY", "password", "access_key", "auth_token", "client_secret", "SECRET_KEY", "AWS_ACCESS_KEY_ID", "DB_PASSWORD_2", "GITHUB_PAT", "STRIPE_KEY")
SIGNS = (" = ", "=", ": ", ' = "', "='", '": "', "     = ", "\t\t\t\t=\t", ":\n    ", ": Bearer ")
B64 = string.ascii_letters + string.digits + "+/"
#: Kinds of secret_values that are known by their form, so that they need no name; the others need one of NAMES that says secret.
FORMED = (2, 3, 4, 5, 7, 8, 9, 10, 11, 12)
SAYING = len(NAMES) - 2


def secret_values(rng: random.Random) -> tuple[str, ...]:
    """One made secret of each kind."""
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    url, alnum, body = B64.replace("+/", "-_"), string.ascii_letters + string.digits, lambda k: "\n".join(pick(B64, 64) for _ in range(k))
    return (
        pick("0123456789abcdef", rng.choice((32, 40, 64))),
        pick(B64, rng.choice((24, 32, 40, 44))),
        "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        "ghp_" + pick(alnum, 36),
        "sk-" + pick(alnum, rng.choice((24, 48))),
        "eyJ" + pick(url, 20) + "." + pick(url, 40) + "." + pick(url, 43),
        pick(alnum + "!@#$%^&*", rng.randrange(10, 20)),
        "-----BEGIN PRIVATE KEY-----\n" + pick(B64, rng.choice((200, 1600))) + "\n-----END PRIVATE KEY-----",
        "sk_live_" + pick(alnum, 24),
        "AIza" + pick(url, 35),
        "hooks.slack.com/services/T" + pick(string.ascii_uppercase + string.digits, 8) + "/B" + pick(string.ascii_uppercase + string.digits, 8) + "/" + pick(alnum, 24),
        "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + pick("0123456789ABCDEF", 32) + "\n\n" + body(4) + "\n-----END RSA PRIVATE KEY-----",
        "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v2.0.22 (GNU/Linux)\n\n" + body(4) + "\n=" + pick(B64, 4) + "\n-----END PGP PRIVATE KEY BLOCK-----",
        # Letters and digits apart, as in keys that were typed or made in groups.
        "".join(pick(string.digits, 10) + pick("abcdef", rng.choice((6, 10))) for _ in range(rng.choice((2, 3)))),
    )


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(before, value, after, label): secrets (1) and what is mistaken for them (0), by fixed rules from a seed."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "in", "ou", "ent", "ment", "ich", "ado", "eau", "ly")) for _ in range(rng.randrange(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(2, 7))) + " "
    terms = WORDS.split("|")

    def secret() -> tuple[str, str]:
        values = secret_values(rng)
        # Those known by their name alone are the harder ones and come more often.
        kind = rng.choice((0, 0, 0, 0, 0, 1, 1, 6, 6, *range(len(values))))
        name = rng.choice(NAMES if kind in FORMED else NAMES[:SAYING])
        if kind in FORMED and rng.random() < 0.5:
            return prose() + rng.choice(("", "", "", "https://", "https://" + word() + ".com/api?key=", "https://" + word() + ".com/")), values[kind]
        if kind == 6 and rng.random() < 0.4:
            # In quotes, with signs that end other values, or as the password of an address.
            if rng.random() < 0.5:
                return prose() + name + rng.choice((' = "', '": "', ': "')), rng.choice((" ", ", ", "<", "; ")).join(secret_values(rng)[6] for _ in range(2))
            return prose() + rng.choice(("https", "postgres", "ftp")) + "://" + word() + ":", values[6].replace("@", "9")
        # A harmless word somewhere before the name says nothing about what the name says.
        aside = rng.choice(("in the file ", "version 2: ", "for the build ", "order it by path, ")) if rng.random() < 0.3 else ""
        return prose() + aside + name + rng.choice(SIGNS), values[kind]

    def other() -> tuple[str, str]:
        kind = rng.randrange(17)
        hexes = "0123456789abcdef"
        return (
            lambda: (prose() + rng.choice(("commit ", "revision ", "sha1 ", "checksum: ", "md5 ", "digest ", "etag ", "hash: ", "commit=", "sha256=", "?v=", "etag=")), pick(hexes, rng.choice((32, 40, 64)))),
            lambda: (prose() + rng.choice(("uuid ", "id ", "guid: ", "")), "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))),
            lambda: (prose() + rng.choice(("see /", "https://", "src=", "file ")), "/".join(rng.choice(terms) for _ in range(4)) + str(rng.randrange(1000))),
            lambda: (prose() + rng.choice(("password = ", "token: ", "api_key=", "secret = '")), rng.choice(("changeme", "your_api_key_here", "xxxxxxxxxxxxxxxx", "<password>", "password123", "insert_token_here", "example_secret", "********"))),
            lambda: (prose() + rng.choice(("card ", "order ", "", "phone ", "tracking ")), pick(string.digits, rng.choice((16, 18, 20)))),
            lambda: (prose(), "_".join(rng.choice(terms) for _ in range(4)) + "_" + str(rng.randrange(100))),
            lambda: (prose(), "".join(rng.choice(terms).capitalize() for _ in range(3)) + str(rng.randrange(10)) + rng.choice(terms).capitalize()),
            lambda: (prose() + "/", "-".join(rng.choice(terms) for _ in range(5)) + "-" + str(rng.randrange(2000, 2030))),
            lambda: (prose() + rng.choice(("token = ", "password: ", "auth: ")), "get" + rng.choice(terms).capitalize() + "From" + rng.choice(terms).capitalize()),
            lambda: (prose(), "-".join(pick(string.digits, k) for k in (4, 2, 2, 6, 3))),
            lambda: (prose(), word() + word() + word() + str(rng.randrange(100)) + word()),
            lambda: (prose() + rng.choice(("author: ", "authors: ", "authority = ", "tokenizer: ", "secretary: ", "tokens=")), rng.choice((word() + word() + word(), rng.choice(terms).capitalize() + rng.choice(terms) + word())) + "ation"),
            lambda: (prose() + "https://" + word() + ".com/" + word() + rng.choice(("?id=", "?page=", "?q=", "?ref=", "?slug=")), "-".join(rng.choice(terms) for _ in range(4)) + "-" + str(rng.randrange(1000))),
            lambda: (prose() + rng.choice(("id=", "class=", "name=", "target=")), "_".join(rng.choice(terms) for _ in range(4)) + str(rng.randrange(100))),
            lambda: (prose() + "data:image/png;base64,", pick(B64, 120)),
            lambda: (prose() + rng.choice(('password: "', 'secret = "', 'token": "', "auth:\n  ")), prose() + prose().strip() + rng.choice(("", ".", "?", ", " + word()))),
            lambda: (prose() + "https://" + word() + ":", rng.choice(("password", "changeme", "xxxxxxxx", "yourpassword", "<password>", "********"))),
        )[kind]()

    rows = []
    for i in range(n):
        before, value = secret() if i % 2 else other()
        rows.append((re.sub(r"\s{4,}", " ", before)[-BESIDE:], value, rng.choice((" ", '" ', "' ", ". ", ", ")) + prose(), i % 2))
    return rows


@dataclass
class Node:
    """A split, or a leaf with the share of secrets where feature is -1."""

    share: float
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH, least: int = 4) -> Node:
    """One tree: at each node the split of least Gini impurity among a random choice of features."""
    node = Node(float(y.mean()))
    if depth == 0 or len(y) < 2 * least or node.share in (0.0, 1.0):
        return node
    best = node.share * (1 - node.share) * len(y) - 1e-9
    for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cut = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= least) & (n[:-1] <= len(y) - least))
        if not len(cut):
            continue
        left, right = n[cut], len(y) - n[cut]
        one_left, one_right = ones[cut], ones[-1] - ones[cut]
        cost = one_left * (1 - one_left / left) + one_right * (1 - one_right / right)
        k = int(cost.argmin())
        if cost[k] < best:
            best, node.feature, node.at = float(cost[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.at
        node.low, node.high = grow(x[low], y[low], rng, depth - 1, least), grow(x[~low], y[~low], rng, depth - 1, least)
    return node


@dataclass
class Forest:
    """Trained trees, and the log-odds of pairs of characters that one of their features is made of."""

    trees: list[Node]
    odds: np.ndarray


def transitions(pairs: list[list[int]], labels: np.ndarray) -> np.ndarray:
    """For each pair of characters the log of how much more often it stands in secrets than in other findings, one occurrence added to each."""
    seen = np.ones((2, SIGNS_TOLD * SIGNS_TOLD))
    for own, label in zip(pairs, labels.astype(int), strict=True):
        np.add.at(seen[label], own, 1)
    share = seen / seen.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None, seed: int = 3) -> Forest:
    """The forest from labelled findings; their features come from the same expressions as in the scan."""
    rows = labelled_findings() if findings is None else findings
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "before string, value string, after string, label int, i int")
    # Findings i and i + 1 are of both kinds in turn, so half of each kind teaches the transitions and half the forest.
    learned = table.where("i % 4 < 2").select("label", pair_codes(F.col("value")).alias("pairs")).toArrow()
    odds = transitions(learned.column("pairs").to_pylist(), np.asarray(learned.column("label")))
    made = table.where("i % 4 >= 2").orderBy("i").select("label", *[c.alias(n) for n, c in zip(FEATURES, features(F.col("before"), F.col("value"), F.col("after"), odds), strict=True)]).toArrow()
    y = np.asarray(made.column("label"), dtype=float)
    x = np.column_stack([np.asarray(made.column(n), dtype=float) for n in FEATURES])
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        own = rng.integers(0, len(y), len(y))
        trees.append(grow(x[own], y[own], rng))
    return Forest(trees, odds)


def probability(forest: Forest, f: list[Column]) -> Column:
    """The mean share of the leaves that a candidate reaches."""

    def of(node: Node) -> Column:
        if node.feature < 0:
            return F.lit(node.share)
        return F.when(f[node.feature] <= node.at, of(node.low)).otherwise(of(node.high))

    return sum((of(t) for t in forest.trees[1:]), of(forest.trees[0])) / len(forest.trees)


def cut_up(text: Column) -> Column:
    """struct<hits array<string>, gaps array<string>>: the candidates of a text and what stands before, between and behind them."""
    return F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split(text, CANDIDATE, -1).alias("gaps"))


def judged(pieces: Column, forest: Forest) -> Column:
    """array<struct<name, value, kind, score>> of the candidates of a text that was cut up: name is what an assignment has before its value."""

    def named(hit: Column) -> Column:
        value = F.regexp_replace(hit, NAME, "")
        return F.struct(F.substring(hit, F.lit(1), F.length(hit) - F.length(value)).alias("name"), value.alias("value"))

    # Only the ends of a piece can stand beside a candidate; the pieces next to it hold BESIDE characters, as no candidate is shorter than 8.
    last = lambda x: F.substring(x, -BESIDE, BESIDE)
    first = lambda x: F.substring(x, 1, BESIDE)
    ends = lambda p: F.struct(
        p["hits"].alias("hits"),
        F.transform(p["hits"], lambda h, i: F.concat(last(F.get(p["gaps"], i)), last(h))).alias("before"),
        F.transform(p["hits"], lambda h, i: F.concat(first(h), first(F.get(p["gaps"], i + 1)))).alias("after"),
        F.transform(p["gaps"], last).alias("gap_before"),
        F.transform(p["gaps"], first).alias("gap_after"),
    )

    def beside(e: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            low = F.greatest(i - PIECES, F.lit(0))
            ahead = F.concat(F.array_join(F.slice(e["before"], low + 1, i - low), ""), F.get(e["gap_before"], i))
            behind = F.concat(F.get(e["gap_after"], i + 1), F.array_join(F.slice(e["after"], i + 2, PIECES), ""))
            # However far a value is moved from its name, the name is beside it.
            near = lambda name: F.regexp_replace(name, r"\s{4,}", " ")
            return let(named(h), lambda v: F.struct(v["name"].alias("name"), v["value"].alias("value"), last(F.concat(ahead, near(v["name"]))).alias("before"), first(behind).alias("after")))

        return F.transform(e["hits"], one)

    def scored(c: Column) -> Column:
        kind = F.when(c["value"].startswith("-----BEGIN"), "private_key").when(c["name"] != "", "assignment").otherwise("run")
        f = F.array(*features(c["before"], c["value"], c["after"], forest.odds))
        by_forest = let(f, lambda x: probability(forest, [F.get(x, F.lit(i)) for i in range(len(FEATURES))]))
        score = F.when(kind == "private_key", F.lit(1.0)).otherwise(by_forest)
        return F.struct(c["name"].alias("name"), c["value"].alias("value"), kind.alias("kind"), score.alias("score"))

    return F.transform(let(let(pieces, ends), beside), scored)


def findings(text: Column, forest: Forest) -> Column:
    """array<struct<start, length, kind, value, score, is_secret>> of a text, start from 0 in code points."""

    def placed(p: Column) -> Column:
        gaps = F.transform(p["gaps"], lambda g: F.length(g))
        sizes = F.zip_with(F.slice(gaps, 1, F.size(p["hits"])), p["hits"], lambda g, h: g + F.length(h))
        starts = F.zip_with(sums_before(sizes), F.slice(gaps, 1, F.size(p["hits"])), lambda a, g: a + g)
        return F.zip_with(
            starts,
            judged(p, forest),
            lambda at, c: F.struct(
                (at + F.length(c["name"])).cast("long").alias("start"),
                F.length(c["value"]).cast("long").alias("length"),
                c["kind"].alias("kind"),
                c["value"].alias("value"),
                c["score"].alias("score"),
                (c["score"] >= SECRET).alias("is_secret"),
            ),
        )

    return let(cut_up(text), placed)


def scan_documents(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """(doc_id, start, length, kind, value_sha256, score, is_secret): one row per candidate."""
    forest = train(docs.sparkSession) if forest is None else forest
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", F.explode(findings(F.col("text"), forest)).alias("f"))
    return rows.select("doc_id", "f.start", "f.length", "f.kind", F.sha2("f.value", 256).alias("value_sha256"), "f.score", "f.is_secret")


def redact(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """The documents with every secret replaced by MASK; n_chars, where there is one, follows a changed text."""
    forest = train(docs.sparkSession) if forest is None else forest
    text = F.col("text")

    def masked(p: Column) -> Column:
        shown = F.transform(judged(p, forest), lambda c: F.concat(c["name"], F.when(c["score"] >= SECRET, F.lit(MASK)).otherwise(c["value"])))
        return F.concat(F.array_join(F.zip_with(F.slice(p["gaps"], 1, F.size(p["hits"])), shown, lambda g, s: F.concat(g, s)), ""), F.element_at(p["gaps"], -1))

    new = "_masked_text"
    changed = docs.withColumn(new, F.when(text.rlike(CANDIDATE), let(cut_up(text), masked)).otherwise(text))
    length = lambda c: F.when(F.col(new) != text, F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return changed.select(*[F.col(new).alias(c) if c == "text" else length(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def digest(value: str) -> str:
    """What value_sha256 holds for a value, for looking up known secrets."""
    return hashlib.sha256(value.encode()).hexdigest()

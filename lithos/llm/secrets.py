"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are values after a telling key (token = "..."), tokens of known
formats, private key blocks, and long mixed tokens with a digit. Each is
described by its length, character transitions, dictionary coverage (words of a
public vocabulary), the path it stands in and its neighbouring words; a random
forest trained from labelled findings votes on it. The forest is written out as SQL
conditions, so candidates, features and votes are DataFrame functions from end to
end; a scan is one pass without a shuffle.

Training: `labelled_findings` makes TRAIN_FINDINGS labelled texts from rules (a
documented bound; real labelled findings can be passed instead).

Values are taken whole: no repetition in the patterns has an upper bound, and each is
possessive, so time grows with the text.

Defined results: null or empty text has no findings; positions count code points
from 0; a null path counts as no path; repeated rows each give their findings;
a key block without its end mark is taken up to its last line of 16 characters or
more and the start of the line after that; of candidates that overlap, the one that starts first counts; other columns
are ignored or, in `redact`, carried; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from string import ascii_lowercase
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.common import discard, materialize, numbered, place, project
from lithos.llm.tokens import read_ranks

TRAIN_FINDINGS = 4000
TREES = 16
DEPTH = 6
SEED = 7
#: Share of votes from which a candidate is a secret.
THRESHOLD = 0.5
#: Characters of text around a candidate that count as its neighbours.
LEFT, RIGHT = 60, 40
MASK = "[SECRET]"
#: Fewest letters of a dictionary word, and how many words (of lowest rank, so the most frequent ones) the dictionary has.
LEAST_WORD, WORDS = 4, 4096
#: Matches whose lengths are added up together.
GROUP = 256

_KEY = (
    r"""(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?)"""
    r"""["']?\s{0,4}[:=]>?\s{0,4}["']?"""
)
_TOKEN_CHAR = r"[A-Za-z0-9+/_\-]"
_BREAK = r"(?:\s|\\[nr])*+"  # between the lines of a key block; in strings of programs line ends are written out
_ENDS = r"-----END [A-Z ]{0,30}PRIVATE KEY-----"
#: Every repetition is unbounded and possessive, so a value of any length is one match and no start is scanned twice.
PATTERN = "|".join((
    # a key block with its header lines, up to its end mark; without one, its lines of 16 characters or more and the one after
    rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:{_BREAK}[A-Za-z][A-Za-z\-]*+: [^\r\n\\]*+)*+"
    rf"(?:(?:[A-Za-z0-9+/=]|\s|\\[nr]){{16,}}+{_ENDS}|(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+)++(?:[ \t]*+(?:\r?\n|\\[nr])++[ \t]*+[A-Za-z0-9+/]{{1,15}}+)?+={{0,2}}+)",
    rf"{_KEY}[^\s\"'<>,;]{{6,}}+",
    r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}+\.eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+",
    rf"(?<!{_TOKEN_CHAR})(?=[A-Za-z+/_\-]*+[0-9]){_TOKEN_CHAR}{{20,}}+={{0,2}}+",
))
# Prefixes and shapes of public key formats.
_KNOWN = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|AIza|sk[_-]|pk[_-]|rk[_-]|glpat-|SG\\.|eyJ|ya29|npm_|-----BEGIN)"
_SECRET_WORDS = r"(?i)(pass(word|wd|phrase)|pwd|secret|token|api.?key|access.?key|credential|auth|private|login|bearer)"
_HASH_WORDS = r"(?i)(commit|sha.?[0-9]*|md5|checksum|digest|etag|uuid|guid|revision|version|isbn|build|blob|image|hash|integrity)"
_FAKE_WORDS = r"(?i)(example|dummy|sample|change.?me|your|placeholder|redacted|todo|xxxx|fake|insert|lorem|\\*\\*\\*|\\.\\.\\.|<)"
_TEST_PATH = r"(?i)(test|example|sample|fixture|mock|docs?/|readme)"
_WORD = re.compile(rb" [a-z]{%d,}" % LEAST_WORD)
FEATURES = (
    "length", "transitions", "digits", "uppers", "symbols", "distinct", "collapsed", "dictionary", "longest_word", "hexadecimal",
    "known", "keyed", "secret_near", "hash_near", "fake", "test_path",
)


class Dictionary(NamedTuple):
    """The words of a public vocabulary, for SQL: word by word, and by their first two letters."""

    words: list[str]
    places: str

    @staticmethod
    def read(rank_file: str) -> Dictionary:
        """The WORDS first tokens of a rank file that are a space and LEAST_WORD or more of a-z."""
        ranks = read_ranks(rank_file)
        words = sorted(t[1:].decode() for t in sorted(filter(_WORD.fullmatch, ranks), key=ranks.__getitem__)[:WORDS])
        by_start: dict[str, list[str]] = {}
        for w in words:
            by_start.setdefault(w[:2], []).append(w)
        lines = (" ".join(["", *by_start.get(x + y, ()), ""]) for x in ascii_lowercase for y in ascii_lowercase)
        return Dictionary(words, f"split('{','.join(lines)}', ',')")

    def holds(self, w: str) -> str:
        """Whether the lower-case letters w are a word, as SQL."""
        return f"coalesce(position(concat(' ', {w}, ' '), get({self.places}, (ascii({w}) - 97) * 26 + ascii(substr({w}, 2, 1)) - 97)) > 0, false)"


class Model(NamedTuple):
    """A trained forest: the share of votes as SQL over a feature struct f, and the dictionary of its features."""

    votes: str
    dictionary: Dictionary


def _quote(s: str) -> str:
    """s as a raw SQL string literal, whose backslashes stand for themselves."""
    return "r'" + s.replace("'", "\\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with name bound to value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _features(path: str | None, dictionary: Dictionary) -> str:
    """SQL of the feature struct of v: value, hit, before, after."""
    where = f"coalesce(`{path}`, '')" if path else "''"
    # plain strings in SQL: \\ in the patterns below stands for one backslash
    classes = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(v.value, '[^A-Za-z0-9]', '_'), '[a-z]', 'a'), '[A-Z]', 'A'), '[0-9]', '0')"
    share = "cast(length(regexp_replace(v.value, '{}', '')) as double) / length(v.value)"
    parts = f"regexp_extract_all(v.value, '[A-Z]?[a-z]{{{LEAST_WORD - 1},}}|[A-Z]{{{LEAST_WORD},}}', 0)"
    features = {
        "length": "cast(length(v.value) as double)",
        "transitions": f"(length(regexp_replace({classes}, '(.)\\\\1+', '$1')) - 1) / cast(length(v.value) as double)",
        "digits": share.format("[^0-9]"),
        "uppers": share.format("[^A-Z]"),
        "symbols": share.format("[A-Za-z0-9]"),
        "distinct": "size(array_distinct(split(v.value, ''))) / cast(least(length(v.value), 64) as double)",
        "collapsed": "length(regexp_replace(v.value, '(.{1,4}?)\\\\1+', '$1')) / cast(length(v.value) as double)",
        "dictionary": f"aggregate(transform({parts}, w -> lower(w)), 0, (n, w) -> n + if({dictionary.holds('w')}, length(w), 0)) / cast(length(v.value) as double)",
        "longest_word": "array_max(transform(split(v.value, '[^A-Za-z]+'), w -> length(w))) / cast(length(v.value) as double)",
        "hexadecimal": "if(v.value rlike '^[0-9a-fA-F]++$', 1D, 0D)",
        "known": f"if(v.value rlike '{_KNOWN}', 1D, 0D)",
        "keyed": "if(length(v.value) < length(v.hit), 1D, 0D)",
        "secret_near": f"if(concat(v.before, v.hit) rlike '{_SECRET_WORDS}', 1D, 0D)",
        "hash_near": f"if(concat(v.before, ' ', v.after) rlike '{_HASH_WORDS}', 1D, 0D)",
        "fake": f"if(concat(v.value, ' ', v.after) rlike '{_FAKE_WORDS}', 1D, 0D)",
        "test_path": f"if({where} rlike '{_TEST_PATH}', 1D, 0D)",
    }
    return f"named_struct({', '.join(f'{k!r}, {e}' for k, e in features.items())})"


def _found(path: str | None, dictionary: Dictionary, fields: str, none: str, whole: str = "{}") -> str:
    """SQL over text: the list of fields of each match, put into whole; none if there is no match.

    fields may use h (the match), i (its number), v (hit, before, after, value) and f (features), both fields and
    whole p (the pieces between matches). It is one expression, so that a row carries nothing but its own columns.
    """
    value = f"coalesce(nullif(regexp_extract(h, {_quote('^(?s)' + _KEY + '(.+)$')}, 1), ''), h)"
    v = f"named_struct('hit', h, 'before', right(get(p, i), {LEFT}), 'after', left(get(p, i + 1), {RIGHT}), 'value', {value})"
    each = f"transform(m, (h, i) -> {_let('v', v, _let('f', _features(path, dictionary), fields))})"
    cut = _let("p", f"split(text, {_quote(PATTERN)}, -1)", whole.replace("{}", each))
    return _let("m", f"regexp_extract_all(text, {_quote(PATTERN)}, 0)", f"if(coalesce(size(m), 0) = 0, {none}, {cut})")


def labelled_findings(spark: SparkSession, rank_file: str, n: int = TRAIN_FINDINGS) -> DataFrame:
    """n labelled texts (text, path, label) made from rules: 1 holds a secret, 0 looks like one.

    Among those that only look like one are identifiers, calls, slugs, numbers, encoded images and
    integrity hashes beside a telling key or without any word that the features know.
    """
    words = Dictionary.read(rank_file).words
    rows = spark.range(0, n, 1, 1).selectExpr(
        "id", "sha2(concat('h', id), 512) as hex", "regexp_replace(base64(unhex(sha2(concat('b', id), 512))), '[^A-Za-z0-9]', '') as alnum",
        "substr(base64(unhex(sha2(concat('c', id), 512))), 1, 60) as b64", "pmod(xxhash64(id, 1), 1000) as r", "pmod(xxhash64(id, 2), 1000) as s",
        f"split('{' '.join(words)}', ' ') as words",
    )
    pick = lambda k: f"get(words, cast(pmod(xxhash64(id, {k}), {len(words)}) as int))"
    name = f"concat_ws('_', {', '.join(pick(k) for k in range(10, 14))})"
    secret_key = "element_at(array('token = \"', 'secret: ', 'password = \\'', 'api_key=', '\"access_key\": \"', 'auth_token=\"'), cast(r % 6 + 1 as int))"
    positive = f"""case s % 11
        when 0 then concat({secret_key}, substr(hex, 1, 40)) when 1 then concat({secret_key}, substr(hex, 1, 32))
        when 2 then concat({secret_key}, substr(b64, 1, 40)) when 3 then concat('AKIA', upper(substr(alnum, 1, 16)), '7')
        when 4 then concat('ghp_', substr(alnum, 1, 36), '3') when 5 then concat({secret_key}, substr(alnum, 1, cast(12 + r % 30 as int)), '!9x')
        when 6 then concat('eyJhbGciOi', substr(alnum, 1, 12), '.eyJzdWIi', substr(alnum, 10, 30), '.', substr(alnum, 20, 40))
        when 7 then concat({pick(20)}, ' ', b64, '4') when 8 then concat({secret_key}, hex)
        when 9 then concat({secret_key}, {pick(21)}, r % 97, substr(alnum, 1, cast(1 + r % 4 as int)))
        else concat({secret_key}, {pick(22)}, element_at(array('!', '@', '#', '$'), cast(r % 4 + 1 as int)), r, upper(substr(alnum, 1, 2))) end"""
    camel = f"concat({pick(30)}, initcap({pick(31)}), initcap({pick(32)}))"
    slug = f"concat_ws('-', {', '.join(pick(k) for k in range(33, 38))})"
    negative = f"""case s % 19
        when 0 then concat('commit ', substr(hex, 1, 40)) when 1 then concat('sha256: ', substr(hex, 1, 64))
        when 2 then concat({name}, '_', r) when 3 then concat({pick(30)}, '/', {pick(31)}, '/', {pick(32)}, '/', {name}, r)
        when 4 then concat({secret_key}, 'your_', {pick(33)}, '_here_1') when 5 then concat({secret_key}, repeat('x', cast(8 + r % 20 as int)))
        when 6 then concat('uuid ', substr(hex, 1, 8), '-', substr(hex, 9, 4), '-', substr(hex, 13, 4), '-', substr(hex, 17, 4), '-', substr(hex, 21, 12))
        when 7 then concat(repeat('-', 20), r, repeat('=', 12)) when 8 then concat({secret_key}, {pick(34)}, {pick(35)}, {pick(36)})
        when 9 then concat('build ', r, repeat(cast(r % 10 as string), 20)) when 10 then concat({secret_key}, {camel}, '(')
        when 11 then concat({secret_key}, {pick(38)}, '.', {camel}, '.', {pick(39)}) when 12 then concat({pick(38)}, '/20', r % 30 + 10, '/', {slug})
        when 13 then concat('data:image/png;base64,', b64, '=') when 14 then concat({pick(38)}, ' ', repeat(cast(r as string), 8))
        when 15 then concat('integrity sha512-', b64, '==') when 16 then concat({secret_key}, {pick(38)}) when 17 then concat({slug}, '-', r)
        else concat({name}, {name}, r % 10) end"""
    around = f"concat_ws(' ', {', '.join(pick(k) for k in range(40, 45))})"
    after = f"concat_ws(' ', {', '.join(pick(k) for k in range(50, 54))})"
    body = f"if(id % 2 = 0, {positive}, {negative})"
    path = f"if(pmod(xxhash64(id, 3), 10) < if(id % 2 = 0, 1, 4), concat('tests/', {pick(60)}), concat('src', r % 20))"
    return rows.selectExpr(f"concat({around}, ' ', {body}, '\" ', {after}) as text", f"{path} as path", "cast(id % 2 = 0 as double) as label")


def _conditions(forest: str) -> tuple[str, int]:
    """A forest's printed trees as one SQL expression over the struct f (votes for a secret), and their number."""
    trees = []
    tree = iter(re.findall(r"(Tree) \d+|If \(feature (\d+) <= ([-\d.E]+)\)|(Else)|Predict: ([\d.]+)", forest))

    def node() -> str:
        head = next(tree)
        if head[4]:
            return "1" if float(head[4]) > 0.5 else "0"
        yes = node()
        next(tree)  # Else
        no = node()
        return yes if yes == no else f"CASE WHEN f.{FEATURES[int(head[1])]} <= {float(head[2])!r}D THEN {yes} ELSE {no} END"

    for head in tree:
        if head[0]:
            trees.append(node())
    return " + ".join(f"({t})" for t in trees), len(trees)


def train(findings: DataFrame, rank_file: str) -> Model:
    """Train on labelled texts (text, path, label), with the words of a public vocabulary as dictionary."""
    dictionary = Dictionary.read(rank_file)
    features = [f"f.{k} as {k}" for k in FEATURES]
    rows = project(findings, text="string", path="string", label="double")
    each = rows.withColumn("f", F.explode(F.expr(_found("path", dictionary, "f", "null")))).selectExpr("label", *features)
    flat = materialize(each, "findings")
    votes, n = _conditions(fit(flat).toDebugString)
    discard(flat)
    return Model(f"({votes}) / {n}D", dictionary)


def fit(findings: DataFrame) -> RandomForestClassificationModel:
    """Spark's forest on rows of a label and FEATURES."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings.coalesce(1)).select("label", "features")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label").fit(data)


def _trained(docs: DataFrame, rank_file: str, model: Model | None) -> Model:
    return model or train(labelled_findings(docs.sparkSession, rank_file), rank_file)


def _starts(found: str) -> str:
    """SQL of found with the start of each value added, from the lengths of pieces and hits; sums of GROUP lengths bound the work."""
    add = "(n, x) -> n + x"
    groups = f"transform(sequence(0, (size(l) - 1) div {GROUP}), g -> aggregate(slice(l, g * {GROUP} + 1, {GROUP}), 0L, {add}))"
    before = f"aggregate(slice(s, 1, i div {GROUP}), 0L, {add}) + aggregate(slice(l, i div {GROUP} * {GROUP} + 1, i % {GROUP}), 0L, {add})"
    placed = f"transform(r, (y, i) -> named_struct('start', {before} + y.passed - y.size, 'x', y))"
    return _let("r", found, f"if(r is null, null, {_let('l', 'transform(r, y -> y.passed)', _let('s', groups, placed))})")


def scan(docs: DataFrame, rank_file: str, path: str = "source", model: Model | None = None) -> DataFrame:
    """One row per candidate: doc_id, start, length (code points), value_sha256, score, is_secret."""
    has_path = path in docs.columns
    rows = project(docs, doc_id="long", text="string", **({path: "string"} if has_path else {}))
    votes, dictionary = _trained(docs, rank_file, model)
    fields = (
        "named_struct('passed', cast(length(get(p, i)) + length(h) as long), 'size', cast(length(v.value) as long), "
        f"'sha', sha2(v.value, 256), 'score', {votes})"
    )
    found = F.expr(_starts(_found(path if has_path else None, dictionary, fields, "null")))
    return rows.select("doc_id", F.explode(found).alias("at")).select(
        "doc_id", F.col("at.start").alias("start"), F.col("at.x.size").alias("length"), F.col("at.x.sha").alias("value_sha256"),
        F.col("at.x.score").alias("score"), (F.col("at.x.score") >= THRESHOLD).alias("is_secret"),
    )


def redact(docs: DataFrame, rank_file: str, path: str = "source", model: Model | None = None) -> DataFrame:
    """docs with every secret's value masked in text and n_chars set anew; all rows and other columns stay."""
    rows, at = numbered(docs), place(docs, "text")
    has_path = path in docs.columns
    votes, dictionary = _trained(docs, rank_file, model)
    masked = f"if({votes} >= {THRESHOLD}, concat(left(h, length(h) - length(v.value)), '{MASK}'), h)"
    clean = "concat(get(p, 0), array_join(transform({}, (y, j) -> concat(y, get(p, j + 1))), ''))"
    own = rows.withColumn("text", F.col(at).cast("string"))
    if has_path:
        own = own.withColumn("path", F.col(place(docs, path)).cast("string"))
    out = own.withColumn(at, F.expr(_found("path" if has_path else None, dictionary, masked, "text", clean)))
    if "n_chars" in docs.columns:
        out = out.withColumn(place(docs, "n_chars"), F.length(at).cast(docs.schema["n_chars"].dataType))
    return out.select(*rows.columns).toDF(*docs.columns)

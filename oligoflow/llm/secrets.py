"""Secret scans: fixed patterns and character Markov models, in SQL expressions only (operator 7).

The patterns find assignments, access keys and hex strings.  Two first-order Markov models over characters judge every
other long token; it is a span of its own if the log-likelihood ratio favours the random one.

Random strings: the patterns' values are labelled samples, and as many pairs again for each of a few alphabets whose
characters follow each other with equal chances.  Ordinary identifiers: long tokens outside the patterns that several documents hold,
whatever their shape, since secrets don't repeat; the same in capitals and capitalised, which a corpus may hold too rarely; and a
fixed list of labelled identifiers (dates, numbers, names of standards, constants, paths) for characters that a corpus may lack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, group whose length counts, least length of it.
BASE_KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
]
#: Characters of candidate tokens, and of the models.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "([A-Za-z0-9+/_=-]{%d,})"
#: Shortest token that the models judge, and shortest ordinary identifier they are trained on.
TOKEN_CHARS, IDENTIFIER_CHARS = 12, 12
#: A long token is a sample of ordinary identifiers if so many documents hold it.
ORDINARY_DOCS = 2
#: Alphabets of random strings.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
RANDOM_ALPHABETS = (LOWER + DIGITS, UPPER + DIGITS, UPPER + LOWER + DIGITS + "+/", LOWER)
#: Share of the ordinary samples that their capital forms count, and that the labelled identifiers count.
CASE_SHARE, LABELLED_SHARE = 0.1, 0.05
#: Counts that smoothing lends to each character of the random and of the ordinary model; least pairs of random samples.
LENT, LEAST_PAIRS = {1: 30.0, 0: 5.0}, 1000
#: Labelled samples of ordinary identifiers.
IDENTIFIERS = """
20240115103000 2024-01-15 2023-12-31 1999-06-30-minutes 15-03-2021 20231105 +442079460958 +4930123456 +33142685300 0800-123-4567 +1-202-555-0143 555-0199-2233
ISBN-9780306406157 978-3-16-148410-0 ISSN-2049-3630 ISO-8859-1 ISO-9001-2015 ISO-27001 RFC-2616 RFC-7231-section-6 RFC-2119-keywords UTF-8-encoding COVID-19 SARS-CoV-2
B-52-bomber MP3-player-2 HTTP-2-server TLS-1-3 IPv6-address SHA-256-digest AES-128-cipher MD5-checksum Base64-encoding
MAX_CONNECTION_POOL_SIZE DEFAULT_TIMEOUT_SECONDS MIN_BUFFER_SIZE HTTP_STATUS_CODE USER_AGENT_STRING LOG_LEVEL_DEBUG ENABLE_FEATURE_FLAGS API_BASE_URL PATH_SEPARATOR_CHAR
README-v2-final report-2021-final chapter-12-notes section-3-2-1 version-1-2-3 v10-release-notes figure-7-caption table-4-results appendix-b-draft draft-03-review
photo-0042-small IMG_20200812 DSC_0001_edited scan0001-page2 getElementById setConnectionTimeout parseHttpResponse createUserAccount toLowerCase maxRetryCount
isValidEmailAddress onButtonClicked user_first_name created_at_timestamp order_line_item total_price_amount is_active_flag num_rows_written customer_id_hash last_updated_by
/usr/local/share/doc /home/user/documents /etc/network/interfaces /var/log/messages en/docs/index images/header/logo_small news/2019/05/12/article blog/2020/11/ten-things
state-of-the-art well-known-problem up-to-date-version north-south-divide twenty-first-century mother-in-law cost-benefit-analysis
covid19-vaccine windows10-update python3-package mysql57-server area51-visitors route66-museum boeing747-pilot
========================== -------------------------- __________________________ +-+-+-+-+-+-+-+-+
""".split()
#: A token is a span if its log-likelihood ratio is at least this in all, and at least this for each step.
LEAST_RATIO, LEAST_MEAN_RATIO = 14.0, 0.5

#: A text without any of these strings (in lower case for the first kind) has no match of the kind; a plain search is many times faster.
NEEDED = {0: ("password", "passwd", "secret", "token", "api"), 1: ("AKIA",)}

#: Matches that are put together at a time.
CHUNK = 512
_SPAN = "struct<start:int,kind:int,end:int,value:int>"


def _spans(text: str, kind: int, pattern: str, group: int, least: int, words: bool = False) -> str:
    """SQL of the array of spans of one pattern: gaps and matches in turn give the places.

    With ``words`` the elements are structs of the span (s) and the match (w).  Matches are taken CHUNK at a time, since
    an array grows by copying.
    """
    p = "r'" + pattern.replace("'", "\\x27") + "'"
    kind_of = f"struct<s:{_SPAN},w:string>" if words else _SPAN
    none = f"cast(array() AS array<{kind_of}>)"
    span = f"named_struct('start', acc.pos + length(z.`0`), 'kind', {kind}, 'end', acc.pos + length(z.`0`) + length(z.`1`), 'value', length(z.`2`))"
    item = f"named_struct('s', {span}, 'w', z.`1`)" if words else span
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))"
    inner = f"aggregate(slice(all, c * {CHUNK} + 1, {CHUNK}), named_struct('pos', outer.pos, 'out', {none}), (acc, z) -> CASE WHEN z.`1` IS NULL THEN acc ELSE named_struct('pos', acc.pos + length(z.`0`) + length(z.`1`), " \
        f"'out', CASE WHEN length(z.`2`) >= {least} THEN concat(acc.out, array({item})) ELSE acc.out END) END, acc -> named_struct('pos', acc.pos, 'out', concat(outer.out, array(acc.out))))"
    found = f"transform(array({zipped}), all -> aggregate(sequence(0, (size(all) - 1) div {CHUNK}), named_struct('pos', 0, 'out', cast(array() AS array<array<{kind_of}>>)), (outer, c) -> {inner}, outer -> flatten(outer.out)))[0]"
    needed = " OR ".join(f"contains({f'lower({text})' if kind == 0 else text}, '{x}')" for x in NEEDED.get(kind, ())) or "true"
    return f"CASE WHEN ({needed}) AND {text} RLIKE {p} THEN {found} ELSE {none} END"


def base_spans(text: str) -> Column:
    """Spans of the fixed patterns in a text column, by start and then kind."""
    return F.expr("array_sort(concat(" + ", ".join(_spans(text, k, p, g, n) for k, (_, p, g, n) in enumerate(BASE_KINDS)) + "))")


def _redacted(text: str, spans: str, mark: str) -> str:
    """SQL of ``text`` with spans (sorted by start) replaced by ``mark``; spans that touch or overlap give one mark each merged run."""
    return f"aggregate({spans}, named_struct('pos', 0, 'out', ''), (acc, s) -> CASE WHEN s.start >= acc.pos THEN named_struct('pos', s.end, 'out', concat(acc.out, substring({text}, acc.pos + 1, s.start - acc.pos), '{mark}')) " \
        f"ELSE named_struct('pos', greatest(acc.pos, s.end), 'out', acc.out) END, acc -> concat(acc.out, substring({text}, acc.pos + 1)))"


def _pairs(token: str) -> str:
    """SQL of the array of character pairs of a token, each as one number, in time that follows its length."""
    n, chars = len(ALPHABET), f"split({token}, '')"
    pairs = f"zip_with({chars}, slice({chars}, 2, greatest(length({token}) - 1, 0)), (a, b) -> (locate(a, '{ALPHABET}') - 1) * {n} + locate(b, '{ALPHABET}'))"
    return f"slice({pairs}, 1, greatest(length({token}) - 1, 0))"  # the last character has no next


def _once(df: DataFrame, name: str, x: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: a generator of one row keeps the optimizer from copying it into every use."""
    return df.drop(name).select("*", F.explode(F.array(x)).alias(name))


def train(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log-likelihood ratios (random over ordinary) of all character pairs, counted over all of ``docs``.

    What comes to the driver is at most two counts for each pair and class.  Both models are smoothed by the frequencies of
    single characters, these by a pseudo-count; if no token is in ORDINARY_DOCS documents all ratios are 0.
    """
    spans = _once(docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")), "b", base_spans("t"))
    rest = _redacted("t", "b", " ")
    words = f"array_distinct(regexp_extract_all({rest}, r'{TOKEN % IDENTIFIER_CHARS}', 1))"
    secret = "transform(b, s -> regexp_replace(substring(t, s.end - s.value + 1, s.value), '[^A-Za-z0-9+/_=-]', ''))"
    samples = spans.select(F.expr(f"concat(transform({secret}, x -> named_struct('y', 1, 'w', x)), transform({words}, x -> named_struct('y', 0, 'w', x)))").alias("x")).select(F.explode("x").alias("x"))
    # each token once, with the number of documents that hold it
    samples = samples.where("length(x.w) >= 2").groupBy("x.y", "x.w").agg(F.count(F.lit(1)).alias("docs")).where(f"y = 1 OR docs >= {ORDINARY_DOCS}")
    # the pairs are a column of their own, so that rows of one pair don't carry the token they are from
    pairs = samples.select("y", "docs", F.expr(_pairs("w")).alias("pairs")).select("y", "docs", F.posexplode("pairs").alias("at", "pair"))
    found = pairs.groupBy("y", "pair", (F.col("at") == 0).alias("first")).agg(F.sum("docs").alias("n")).collect()
    return _ratios([(r["y"], r["pair"], r["first"], r["n"]) for r in found])


def _ratios(found: list[tuple[int, int, bool, int]]) -> list[float]:
    """Ratios from counts of (class, pair, whether the pair begins a token)."""
    n, place = len(ALPHABET), {c: k for k, c in enumerate(ALPHABET)}
    if not any(y == 0 for y, *_ in found):
        return [0.0] * (n * n)
    count = {y: [[0.0] * n for _ in range(n)] for y in (0, 1)}
    capital = [place[c.upper()] for c in ALPHABET]
    for y, pair, first, x in found:
        a, b = divmod(pair - 1, n)  # _pairs counts from 1
        count[y][a][b] += x
        if y == 0:
            count[0][capital[a]][capital[b]] += CASE_SHARE * x  # in capitals
            count[0][capital[a] if first else a][b] += CASE_SHARE * x  # capitalised
    total = {y: sum(map(sum, count[y])) for y in (0, 1)}
    for letters in RANDOM_ALPHABETS:
        each = max(total[1], LEAST_PAIRS) / len(letters) ** 2
        for a in letters:
            for b in letters:
                count[1][place[a]][place[b]] += each
    labelled = [(place[a], place[b]) for w in IDENTIFIERS for a, b in zip(w, w[1:], strict=False)]
    for a, b in labelled:
        count[0][a][b] += LABELLED_SHARE * total[0] / len(labelled)
    logs = {}
    for y in (0, 1):
        after = [sum(count[y][a][b] for a in range(n)) for b in range(n)]
        alone = [(x + 1) / (sum(after) + n) for x in after]
        logs[y] = [[math.log((count[y][a][b] + LENT[y] * alone[b]) / (sum(count[y][a]) + LENT[y])) for b in range(n)] for a in range(n)]
    return [logs[1][a][b] - logs[0][a][b] for a in range(n) for b in range(n)]


def scan(docs: DataFrame, model: list[float], text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """``docs`` with ``base`` (spans of the fixed patterns) and ``spans`` (those and the models' spans), arrays by start and kind.

    Starts count code points from 0, ends are exclusive; kind is a number (0 assign, 1 access, 2 hex,
    3 markov).  Null and empty texts have no spans.  Columns of ``docs`` with these names are replaced; :func:`redact` and
    :func:`secret_report` choose names that clash with none.  Rows that repeat an id or have a null one are rows of their own; no
    rows give no rows.  A text of any length is matched whole, by a task that holds it.
    """
    text = f"coalesce(`{text_col}`, '')"
    ratios = "split('" + ",".join(f"{x:.5g}" for x in model) + "', ',')"
    out = _once(docs, base_col, base_spans(text))
    tokens = _spans(text, len(BASE_KINDS), TOKEN % TOKEN_CHARS, 1, TOKEN_CHARS, words=True)
    score = f"aggregate({_pairs('u.w')}, 0D, (x, i) -> x + element_at(cast({ratios} AS array<double>), i))"
    judged = f"filter({tokens}, u -> NOT exists(`{base_col}`, b -> b.start < u.s.end AND u.s.start < b.end) AND {score} >= greatest({LEAST_RATIO}D, {LEAST_MEAN_RATIO}D * (length(u.w) - 1)))"
    return _once(out, spans_col, F.expr(f"array_sort(concat(`{base_col}`, transform({judged}, u -> u.s)))"))


def span_text(spans: str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    names = "element_at(array('" + "','".join([k for k, *_ in BASE_KINDS] + ["markov"]) + "'), s.kind + 1)"
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {names}, cast(s.start AS string), cast(s.end AS string))), ',')")


def secret_report(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of ``docs`` (doc_id, text; other columns are not read)."""
    found = scan(docs.select("doc_id", "text"), train(docs) if model is None else model)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS long)").alias(f"n_{name}") for k, (name, *_) in enumerate(BASE_KINDS)]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def redact(docs: DataFrame, model: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; all columns stay, n_chars (if any) is counted anew.  Null texts stay null."""
    names = ["_base", "_spans"]
    while set(names) & set(docs.columns):
        names = [f"{x}_" for x in names]
    found = scan(docs, train(docs) if model is None else model, base_col=names[0], spans_col=names[1])
    found = found.withColumn("text", F.expr(f"CASE WHEN text IS NULL OR size({names[1]}) = 0 THEN text ELSE {_redacted('text', names[1], mark)} END")).drop(*names)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found

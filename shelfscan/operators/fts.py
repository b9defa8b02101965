"""Full-text search over postings: tokens, expressions, ranking, snippets."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfscan.session import spread, written

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
#: Saturation and length weight of the ranking, and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _folding() -> tuple[str, str]:
    """Latin letters with marks, by rule: those that decompose into an ASCII letter and marks lose the marks."""
    source, target = [], []
    for o in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(o))
        if len(base) > 1 and base[0].isascii() and chr(o) == chr(o).lower():
            source.append(chr(o))
            target.append(base[0].lower())
    return "".join(source), "".join(target)


MARKED, BARE = _folding()


def fold(text: str) -> str:
    return text.lower().translate(str.maketrans(MARKED, BARE))


def tokens(body: Column) -> Column:
    """Folded tokens of a text in order: runs of letters, numbers and private characters."""
    return F.regexp_extract_all(F.translate(F.lower(body), MARKED, BARE), F.lit(TOKEN), F.lit(0))


def _tokenized(docs: DataFrame) -> DataFrame:
    """id, t of the texts that count: with an id and not null."""
    return spread(docs.where(F.col("id").isNotNull() & F.col("body").isNotNull()).select("id", "body"), "id").select("id", tokens(F.col("body")).alias("t"))


def postings(docs: DataFrame) -> DataFrame:
    """term, id, at (positions in order), length (tokens of the text) of docs(id, body). Null bodies have none. Sorted by term
    when stored, a term or prefix filter reads only its row groups."""
    rows = _tokenized(docs).where(F.size("t") > 0)
    spread = rows.select("id", F.size("t").alias("length"), F.posexplode("t").alias("pos", "term"))
    return spread.groupBy("term", "id", "length").agg(F.sort_array(F.collect_list("pos")).alias("at")).select("term", "id", "at", "length")


def vocabulary(docs: DataFrame) -> DataFrame:
    """term, docs, hits of every token. Each text gives a row a distinct token with its count, worked out within the row; one aggregate by term with map-side
    combine adds them up, and no positions move."""
    t = F.col("t")
    ordered = _tokenized(docs).select(F.sort_array("t").alias("t"))
    # in order, a token's run begins where it differs from the one before
    starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (t[i] != t[i - 1]))
    runs = ordered.where(F.size("t") > 0).select("t", starts.alias("s"))
    ends = F.concat(F.slice("s", 2, F.size("s")), F.array(F.size("t")))
    each = runs.select(F.explode(F.zip_with("s", ends, lambda a, b: F.struct(t[a].alias("term"), (b - a).alias("n")))).alias("x")).select("x.*")
    return each.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("hits"))


@dataclass(frozen=True)
class Stored:
    """What an index keeps of its texts: postings(term, id, at, length, gen), sorted by term in each of its versions, and current(id, length, gen), one row a
    text. A text that was read again has postings of several gens, of which the current one counts; so an update adds rows and rewrites none."""

    postings: DataFrame
    current: DataFrame

    def of(self, terms: Column) -> DataFrame:
        """The current postings of the terms that a condition picks; it reaches the scan."""
        return self.postings.where(terms).join(self.current.select("id", "gen"), ["id", "gen"], "left_semi")


# --- expressions ---------------------------------------------------------------


class SyntaxProblem(ValueError):
    """The text is no expression of the search language."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False  # the last word may go on
    initial: bool = False  # at the start of the text


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    left: object
    right: object


LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()^*+:,{}\-])|([\w\u0080-\U0010ffff]+))')
STRENGTH = {"or": 1, "and": 2, "not": 3, "": 4}


class _Parser:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = LEX.match(text, at)
            if not m:
                raise SyntaxProblem(f"unexpected {text[at:at + 1]!r}")
            quoted, sign, word = m.groups()
            self.items.append(("text", quoted[1:-1].replace('""', '"')) if quoted is not None else ("sign", sign) if sign else ("word", word))
            at = m.end()
        self.i = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.i + ahead] if self.i + ahead < len(self.items) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        item = self.peek()
        if item[0] == "end" or sign and item != ("sign", sign):
            raise SyntaxProblem(f"expected {sign or 'a term'}")
        self.i += 1
        return item

    def whole(self):
        out = self.expression(1)
        if self.peek()[0] != "end":
            raise SyntaxProblem(f"unexpected {self.peek()[1]!r}")
        return out

    def expression(self, least: int):
        left = self.operand()
        while True:
            kind, value = self.peek()
            op = value.lower() if kind == "word" and value in ("AND", "OR", "NOT") else "" if kind in ("word", "text") or (kind, value) in (("sign", "("), ("sign", "^")) else None
            if op is None or STRENGTH[op] < least:
                return left
            if op:
                self.i += 1
            left = Op(op or "and", left, self.expression(STRENGTH[op] + 1))

    def operand(self):
        if self.peek() == ("sign", "("):
            self.i += 1
            inner = self.expression(1)
            self.take(")")
            return inner
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            self.i += 2
            phrases = []
            while self.peek() not in (("sign", ")"), ("sign", ",")):
                phrases.append(self.phrase())
            distance = 10
            if self.take()[1] == ",":
                kind, value = self.take()
                if kind != "word" or not value.isascii() or not value.isdigit():
                    raise SyntaxProblem("expected a distance")
                distance = int(value)
                self.take(")")
            if not phrases:
                raise SyntaxProblem("expected a phrase")
            return Near(tuple(phrases), distance)
        return self.phrase()

    def phrase(self) -> Phrase:
        if self.peek()[0] == "word" and self.peek(1) == ("sign", ":"):
            if self.peek()[1].lower() != "body":
                raise SyntaxProblem(f"no such column: {self.peek()[1]}")
            self.i += 2
        initial = self.peek() == ("sign", "^")
        self.i += initial
        words = list(self.string())
        while self.peek() == ("sign", "+"):
            self.i += 1
            words += self.string()
        prefix = self.peek() == ("sign", "*")
        self.i += prefix
        return Phrase(tuple(words), prefix, initial)

    def string(self) -> list[str]:
        kind, value = self.take()
        if kind == "sign" or kind == "word" and value in ("AND", "OR", "NOT"):
            raise SyntaxProblem(f"unexpected {value!r}")
        return [x for x in _SPLIT.findall(fold(value))]


_SPLIT = re.compile(r"[^\W_]+")


def parse(text: str):
    """The expression of a text; SyntaxProblem if it is none. Implicit AND binds closest, then NOT, AND, OR; NOT stands between two."""
    return _Parser(text).whole()


def safe(text: str, negative: bool = False):
    """The expression of a text, or of its plain words as prefixes where it is none; words in capitals that would join terms
    are left out. If no word is left, a negative matches nothing and a positive is an error."""
    try:
        return parse(text)
    except SyntaxProblem:
        words = [w for w in re.findall(r"\w+", text) if w not in ("AND", "OR", "NOT", "NEAR")]
        if not words and not negative:
            raise
        parts = [Phrase(tuple(_SPLIT.findall(fold(w))), True) for w in words]
        return reduce(lambda a, b: Op("and", a, b), parts) if parts else Phrase(())


def _phrases(node) -> list[Phrase]:
    if isinstance(node, Op):
        return _phrases(node.left) + _phrases(node.right)
    return list(node.phrases) if isinstance(node, Near) else [node]


# --- matching ------------------------------------------------------------------


def _starts(p: Phrase, at: dict) -> Column:
    """Positions at which a phrase begins, from the positions of its words."""
    if not p.words:
        return F.array().cast("array<int>")
    words = [at[w, p.prefix and k == len(p.words) - 1] for k, w in enumerate(p.words)]
    out = words[0]
    for k in range(1, len(words)):
        out = F.filter(out, _followed(words[k], k))
    return F.filter(out, lambda x: x == 0) if p.initial else out


def _followed(at: Column, by: int):
    return lambda x: F.array_contains(at, x + by)


def _within(x: Column, length: int, distance: int):
    """y starts no earlier than x and at most `distance` words after the phrase at x ends."""
    return lambda y: (y >= x) & (y - (x + length) <= distance)


def _near(node: Near, starts: list[Column]) -> list[Column]:
    """Of each phrase, the positions that have all others in reach, a distance counting the words between the first's end and the last's start."""
    if len(starts) < 2:
        return starts
    lengths = [len(p.words) for p in node.phrases]

    def begins(i: int):  # a clump, as its first phrase
        others = [s for j, s in enumerate(starts) if j != i]
        return lambda x: reduce(lambda a, b: a & b, (F.exists(s, _within(x, lengths[i], node.distance)) for s in others))

    anchors = [F.filter(s, begins(i)) for i, s in enumerate(starts)]

    def holds(y: Column, i: int) -> Column:
        return F.exists(anchors[i], lambda x: (y >= x) & (y - (x + lengths[i]) <= node.distance))

    return [F.filter(s, lambda y: reduce(lambda a, b: a | b, (holds(y, i) for i in range(len(starts))))) for s in starts]


def _positions(docs: DataFrame, posts: Stored | DataFrame | None, atoms: list[tuple[str, bool]]) -> DataFrame:
    """id, length, a0, a1, ...: where in a text each atom (a word, or words that begin so) stands. From the texts themselves it is a row a text and
    nothing moves; from stored postings a row a text that holds an atom, of which only their row groups are read."""
    fits = lambda x, a: x.startswith(a[0]) if a[1] else x == a[0]
    if posts is None:

        def at(a):
            return F.filter(F.transform("t", lambda x, i: F.when(fits(x, a), i)), lambda i: i.isNotNull())

        return _tokenized(docs).select("id", F.size("t").alias("length"), *(at(a).alias(f"a{k}") for k, a in enumerate(atoms)))
    tests = [fits(F.col("term"), a) for a in atoms]
    wanted = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    needed = posts.of(wanted) if isinstance(posts, Stored) else posts.where(wanted)
    lists = (F.sort_array(F.flatten(F.collect_list(F.when(t, F.col("at"))))).alias(f"a{k}") for k, t in enumerate(tests))
    return needed.groupBy("id").agg(F.first("length").alias("length"), *lists)


def _hits(docs: DataFrame, posts: DataFrame | None, node) -> tuple[DataFrame, int, Column, list[Column]]:
    """Rows of _positions with p0, p1, ... the positions of each phrase (within reach, in a NEAR), r0, r1, ... whether it is
    there at all; the number of phrases, whether the text matches, and for each phrase whether it bears on the match: the operators
    around it hold, and it is not what a NOT excludes."""
    phrases = _phrases(node)
    atoms = sorted({(w, p.prefix and k == len(p.words) - 1) for p in phrases for k, w in enumerate(p.words)})
    at = {a: F.col(f"a{i}") for i, a in enumerate(atoms)}
    columns: list[Column] = []
    bears: list[list[Column]] = []

    def walk(n) -> tuple[Column, list[int]]:
        if isinstance(n, Op):
            (left, i), (right, j) = walk(n.left), walk(n.right)
            held = {"and": left & right, "or": left | right, "not": left & ~right}[n.kind]
            for k in i + j if n.kind == "and" else i if n.kind == "not" else []:
                bears[k].append(held)
            for k in j if n.kind == "not" else []:
                bears[k].append(F.lit(False))
            return held, i + j
        raw = [_starts(p, at) for p in (n.phrases if isinstance(n, Near) else [n])]
        numbers = list(range(len(bears), len(bears) + len(raw)))
        for k, own, there in zip(numbers, _near(n, raw) if isinstance(n, Near) else raw, raw):
            columns.extend([own.alias(f"p{k}"), (F.size(there) > 0).alias(f"r{k}")])
            bears.append([])
        return reduce(lambda a, b: a & b, (F.size(f"p{k}") > 0 for k in numbers)), numbers

    matched, numbers = walk(node)
    return _positions(docs, posts, atoms).select("id", "length", *columns), len(numbers), matched, [reduce(lambda a, b: a & b, x, F.lit(True)) for x in bears]


def _node(query):
    return parse(query) if isinstance(query, str) else query


def matching(docs: DataFrame, query, posts: Stored | DataFrame | None = None) -> DataFrame:
    """id of the texts that match (a text to parse, or an expression). Null and empty texts never match; no words, no match."""
    rows, _, matched, _ = _hits(docs, posts, _node(query))
    return rows.where(matched).select("id")


def ranked(docs: DataFrame, query, posts: Stored | DataFrame | None = None) -> DataFrame:
    """id, score of the texts that match; the lower the better (bm25, negated). The number of texts, their mean length
    and the texts each phrase is in are counted over all texts: one row of figures. From the texts themselves they are observed while the matching
    rows are written, so that every text is taken apart once."""
    rows, phrases, matched, bears = _hits(docs, posts, _node(query))
    if not phrases or not any(p.words for p in _phrases(_node(query))):
        return rows.where(matched).select("id", F.lit(0.0).alias("score"))
    within = [F.count_if(f"r{k}").alias(f"n{k}") for k in range(phrases)]
    whole = [F.count("*").alias("n"), F.sum("length").alias("all")]
    if posts is None:
        seen = Observation()
        bear = [b.alias(f"b{k}") for k, b in enumerate(bears)]
        hits = rows.observe(seen, *whole, *within).where(matched).select("id", "length", *(f"p{k}" for k in range(phrases)), *bear)
        rows, matched, bears = written(hits, "hits"), F.lit(True), [F.col(f"b{k}") for k in range(phrases)]
        figures = within_row = seen.get or {"n": 0}
    else:
        within_row = rows.agg(*within).collect()[0]
        lengths = posts.current if isinstance(posts, Stored) else _tokenized(docs).select(F.size("t").alias("length"))
        figures = lengths.agg(*whole).collect()[0]
    if not figures["n"]:
        return rows.where(matched).select("id", F.lit(0.0).alias("score"))
    mean = max(1e-9, (figures["all"] or 0) / figures["n"])
    score = F.lit(0.0)
    for k in range(phrases):
        n = F.lit(float(within_row[f"n{k}"]))
        idf = F.greatest(F.log((F.lit(float(figures["n"])) - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        f = F.when(bears[k], F.size(f"p{k}")).otherwise(0).cast("double")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / mean))
    return rows.where(matched).select("id", score.alias("score"))


def search(files: DataFrame, docs: DataFrame, query: str, limit: int = 25, exts: list[str] | None = None, stored: Stored | None = None, snippets: bool = False) -> DataFrame:
    """path, score (with snippets also size, mtime, is_dir and snippet) of the best texts of an expression, of some extensions only if given; ties by path."""
    rows = ranked(docs, query, stored).join(files.select("id", "path", "ext", "size", "mtime", "is_dir"), "id")
    if exts:
        rows = rows.where(F.col("ext").isin(exts))
    rows = rows.orderBy("score", "path")
    rows = rows.limit(limit) if limit > 0 else rows
    if not snippets:
        return rows.select("path", "score")
    return with_snippets(rows, docs, query, ["score", "path"]).select("path", "size", "mtime", "is_dir", "score", "snippet")


def with_snippets(hits: DataFrame, docs: DataFrame, query, order: list[str]) -> DataFrame:
    """hits(id, ...) with a snippet of each text, in order: only the texts of the hits are read through."""
    return hits.join(docs.select("id", F.col("body").alias("__body")), "id", "left").withColumn("snippet", snippet(F.col("__body"), query)).drop("__body").orderBy(*order)


def snippet(body: Column, query, width: int = 14) -> Column:
    """The stretch of `width` tokens with the most hits, `>>` and `<<` around them, `...` where text is left out. For limited results: Python."""
    wanted = [(p.words, p.prefix) for p in _phrases(_node(query)) if p.words]
    token = re.compile(r"[^\W_]+")

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        spans = [m.span() for m in token.finditer(text)]
        folded = [fold(text[a:b]) for a, b in spans]
        hit = [False] * len(spans)
        ends = []
        for words, prefix in wanted:
            for i in range(len(folded) - len(words) + 1):
                last = folded[i + len(words) - 1]
                if folded[i : i + len(words) - 1] == list(words[:-1]) and (last.startswith(words[-1]) if prefix else last == words[-1]):
                    ends.append((i, i + len(words)))
                    hit[i : i + len(words)] = [True] * len(words)
        if not spans:
            return ""
        sums = [0]
        for h in hit:
            sums.append(sums[-1] + h)
        start = max(range(max(1, len(spans) - width + 1)), key=lambda s: (sums[min(len(spans), s + width)] - sums[s], -s))
        stop = min(len(spans), start + width)
        out, at = [], spans[start][0] if start else 0
        opened = False
        for k in range(start, stop):
            a, b = spans[k]
            if hit[k] and not opened:
                out.append(text[at:a] + ">>")
                at, opened = a, True
            out.append(text[at:b])
            at = b
            if opened and (k + 1 == stop or not hit[k + 1] or any(e == k + 1 for _, e in ends)):
                out.append("<<")
                opened = False
        out.append(text[at:] if stop == len(spans) else "")
        return (" ... " if start else "") + "".join(out) + (" ... " if stop < len(spans) else "")

    return F.pandas_udf(lambda s: pd.Series([one(x) for x in s]), "string")(body)

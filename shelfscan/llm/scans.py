"""Text of scanned pages: found by its traces, and repaired into continuous paragraphs.

Words cut at line ends, misread characters, running headers and page numbers are the traces. Misread words are found
corpus-wide: a rare word that glyph edits turn into a frequent one, which skip-gram vectors place in like contexts. Where a word
may stand for several, the words around each place decide.

The vectors are learned as skip-gram with negative sampling does in the limit, by factorising the words' pointwise mutual information with
what stands within WINDOW of them. Contexts fall into BUCKETS by hash, so the factorisation is of one small matrix, added up over all documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.session import spread, written

#: Buckets of context words, dimensions of a vector, words each side that are its context.
BUCKETS, DIMENSIONS, WINDOW = 256, 64, 2
#: Links whose contexts are further apart are dropped, where the rare word has at least CONTEXTS of them.
LIKE, CONTEXTS = 0.0, 4
#: What the likeness of the words around a place counts beside the worth of a link, and what a capital at a sentence's beginning (or none within) does.
AT_PLACE, AT_START = 0.5, 0.7


@dataclass(frozen=True)
class Rules:
    """What counts as a page and as a misreading; every figure is a parameter of scanned()."""

    ratio: int = 20  # a correct word is this many times as frequent as its misreading, by documents,
    frequent: int = 5  # and is in at least so many documents
    shortest: int = 4  # characters of a word that can be linked
    edits: int = 3  # glyph edits of a word without signs, at most
    least_line: int = 25  # characters of a line that runs on,
    long_line: int = 110  # and at most
    least_running: int = 2  # lines that run on, of a page
    short_line: int = 60  # characters of a header or page number, at most


RULES = Rules()

# What recognition writes for what was printed.
GLYPHS = (
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("y", "v"), ("v", "y"), ("vv", "w"), ("w", "vv"), ("i", "l"), ("l", "i"),
    ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("0", "o"), ("0", "о"), ("@", "a"), ("@", "а"), ("9", "g"), ("5", "s"), ("8", "b"), ("6", "b"), ("$", "s"), ("(", "c"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("а", "a"),
    ("ы", "ьі"), ("ьі", "ы"),
)
#: Strokes that glyphs fall into; words of one skeleton may stand for each other.
STROKES = {"m": "rri", "w": "cc", "v": "c", "y": "c", "d": "ci", "n": "ri", "h": "ii", "b": "ii", "u": "ii", "ü": "ii", "ú": "ii", "e": "c", "f": "t", "l": "i", "j": "i", "1": "i", "!": "i", "|": "i", "0": "o", "о": "o", "@": "a", "а": "a", "9": "g", "5": "s", "3": "c", "4": "a", "7": "t", "2": "z", "$": "s", "8": "ii", "6": "ii", "(": "c", "ы": "ьі", "ﬁ": "ti", "ﬂ": "ti"}

#: Words, and words with a sign or digit inside; none beside a character that was lost.
WORD = re.compile(r"(?<![^\W\d_]|\ufffd)[^\W\d_]+(?:[0-9!@|$][^\W\d_]+)*(?![^\W\d_]|\ufffd)")
INNER = re.compile(r"(?<=[^\W\d_])[0-9!@|$](?=[^\W\d_])")
#: What stands between blanks and punctuation: words with digits and signs at either edge and in runs, numbers, addresses.
RUN = re.compile(r"[\w!@|$\ufffd]+")
SIGN = re.compile(r"[0-9!@|$]")
#: What follows the first word after the @ of an address.
DOMAIN = re.compile(r"(?:-\w+)*\.\w")
HYPHENS = "-‐¬\xad"
CUT = re.compile(rf"([^\W\d_]+)[{HYPHENS}]$")
BREAK = re.compile(rf"[^\W\d_][{HYPHENS}][ \t\r]*\n")
NUMBER = re.compile(r"\d{1,4}")
#: A lone sign in running text.
SPECK = re.compile(r"(?<=\S) (?:[|^~·•¦`´]|[.,'] ?,) (?=\S)")


def skeleton(word: str) -> str:
    return "".join(STROKES.get(c, c) for c in word.lower())


def glyph_edits(rare: str, frequent: str, most: int = 3) -> int | None:
    """The fewest glyph edits that turn the rare word into the frequent one, or None; at most `most`."""
    if rare == frequent:
        return 0
    best = {(0, 0): 0}
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        e = best[i, j]
        if i < len(rare) and j < len(frequent) and rare[i] == frequent[j] and best.get((i + 1, j + 1), 99) > e:
            best[i + 1, j + 1] = e
            stack.append((i + 1, j + 1))
        if e < most:
            for a, b in GLYPHS:
                for x, y in ((a, b), (a.capitalize(), b.capitalize())):
                    if rare.startswith(x, i) and frequent.startswith(y, j) and best.get((i + len(x), j + len(y)), 99) > e + 1:
                        best[i + len(x), j + len(y)] = e + 1
                        stack.append((i + len(x), j + len(y)))
    return best.get((len(rare), len(frequent)))


def forms(run: str) -> list[str]:
    """What a run may be as one misread word: as it is, without the marks after it, and without those around it. At least half of it
    are letters, so numbers are none; words that WORD finds are left out."""
    out = []
    for form in dict.fromkeys((run, run.rstrip("!|"), run.strip("!|"))):
        signs = len(SIGN.findall(form))
        letters = sum(c.isalpha() for c in form)
        if signs and letters >= signs and letters + signs == len(form) and not WORD.fullmatch(form):
            out.append(form)
    return out


def words_of(text: str) -> list[str]:
    """The words of a text as WORD finds them, each run that is none preceded by its forms."""
    out = []
    for run in RUN.findall(text):
        if run.isalpha():
            out.append(run)
        elif not run.isdigit():
            out += forms(run)
            out += WORD.findall(run)
    return out


def _counts(batches):
    """(word, df): in how many of the documents each word is, added up as far as memory allows."""

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "df"])

    held: Counter = Counter()
    for batch in batches:
        for text in batch.column(1).to_pylist():
            held.update(set(words_of(text)))
        if len(held) > 300_000:
            yield out(held)
            held = Counter()
    if held:
        yield out(held)


def _bare(batches):
    for batch in batches:
        words = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([skeleton(w) for w in words])], ["word", "df", "bare"])


def _edits(rare: str, frequent: str, most: int) -> int | None:
    """Glyph edits within the bound; every sign is one, and a word in capitals with signs may stand for one that is not in capitals."""
    signs = len(SIGN.findall(rare))
    if signs and rare.isupper():
        rare, frequent = rare.lower(), frequent.lower()
    return glyph_edits(rare, frequent, max(min(most, max(1, len(frequent) // 3)), signs))


def _edited(most: int):
    def run(batches):
        for batch in batches:
            edits = [_edits(a, b, most) for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            keep = pa.array([e is not None for e in edits])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([e or 0 for e in edits], pa.int32())], ["rare", "rare_df", "word", "df", "edits"]).filter(keep)

    return run


def links(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """rare, rare_df, word, df, edits: each rare word with the frequent words that glyph edits make of it. Words are counted over
    all documents; rare and frequent words meet by skeleton, an equi-join. A word with signs is none of its own: what it stands for
    need only be more frequent. A mark after a frequent word is a mark."""
    words = written(docs.mapInArrow(_counts, "word string, df bigint").groupBy("word").agg(F.sum("df").alias("df")).where(F.length("word") >= rules.shortest - 1))
    plain = words.where((F.col("df") >= rules.frequent) & ~F.col("word").rlike("[0-9!@|$]"))
    bare = words.where(F.length("word") >= rules.shortest).mapInArrow(_bare, "word string, df bigint, bare string")
    frequent = bare.where((F.col("df") >= rules.frequent) & ~F.col("word").rlike("[0-9!@|$]"))
    rare = bare.select(F.col("word").alias("rare"), F.col("df").alias("rare_df"), "bare")
    marked = F.col("rare").rlike("[!|]$")
    signed = F.col("rare").rlike("[0-9!@|$]") & ~marked
    met = rare.join(frequent, "bare").where((F.col("rare") != F.col("word")) & ((F.col("df") >= rules.ratio * F.col("rare_df")) | signed & (F.col("df") > F.col("rare_df"))))
    found = met.select("rare", "rare_df", "word", "df").mapInArrow(_edited(rules.edits), "rare string, rare_df bigint, word string, df bigint, edits int")
    ends = plain.select(F.col("word").alias("end"))
    return found.join(ends, marked & (F.regexp_replace("rare", "[!|]+$", "") == F.col("end")), "left_anti")


#: Slots of the bitmap of linked words that every task of the vector pass holds; the same for every corpus.
SLOTS = 1 << 20


def _hash(words: list[str]) -> np.ndarray:
    from shelfscan.llm.near import _held

    return np.fromiter(map(_held.__getitem__, words), np.uint64, len(words))


def _linked_slots(batches):
    """The bitmap's slots that linked words take, once a task."""
    taken = np.zeros(SLOTS, bool)
    for batch in batches:
        for k in range(2):
            taken[(_hash(batch.column(k).to_pylist()) & np.uint64(SLOTS - 1)).astype(np.int64)] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(taken))], ["slot"])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % BUCKETS


def _contexts(taken):
    """(word, counts, n): how often each bucket's words stand around the occurrences of a linked word."""
    bitmap = np.unpackbits(np.frombuffer(taken, np.uint8)).astype(bool)

    def run(batches):
        for batch in batches:
            found = [words_of(t) for t in batch.column(1).to_pylist()]
            words = [w for f in found for w in f]
            if not words:
                continue
            h = _hash(words)
            doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
            hit = np.flatnonzero(bitmap[(h & np.uint64(SLOTS - 1)).astype(np.int64)])
            if not len(hit):
                continue
            _, first, index = np.unique(h[hit], return_index=True, return_inverse=True)
            bucket, total = _bucket(h), np.zeros(len(first) * BUCKETS, np.int64)
            for step in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
                at = hit + step
                ok = (at >= 0) & (at < len(h))
                ok[ok] &= doc[at[ok]] == doc[hit[ok]]
                total += np.bincount(index[ok] * BUCKETS + bucket[at[ok]], minlength=len(total))
            yield _count_rows([words[hit[k]] for k in first], total, np.bincount(index))

    return run


def _count_rows(words, counts, n):
    flat = pa.FixedSizeListArray.from_arrays(pa.array(counts.astype(np.float32).ravel()), BUCKETS).cast(pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), flat, pa.array(n.astype(np.int64))], ["word", "counts", "n"])


def _counted(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, BUCKETS).astype(np.float64)


def _summed(batches):
    """Rows come ordered by word: one sum a word; the last word of a batch may go on in the next."""
    held = None
    for batch in batches:
        words, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
        v = _counted(batch.column(1))
        if not len(words):
            continue
        if held is not None:
            words, v, n = np.concatenate([held[0], words]), np.concatenate([held[1], v]), np.concatenate([held[2], n])
        starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        v, n, words = np.add.reduceat(v, starts), np.add.reduceat(n, starts), words[starts]
        held = words[-1:], v[-1:], n[-1:]
        if len(words) > 1:
            yield _count_rows(words[:-1], v[:-1], n[:-1])
    if held is not None:
        yield _count_rows(*held)


def contexts(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """word, counts, n of the linked words over all documents."""
    slots = linked.select("rare", "word").mapInArrow(_linked_slots, "slot bigint").distinct()
    bits = np.zeros(SLOTS, bool)
    bits[[r[0] for r in slots.collect()]] = True  # at most SLOTS numbers
    taken = np.packbits(bits).tobytes()
    rows = docs.mapInArrow(_contexts(taken), "word string, counts array<float>, n bigint")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(_summed, "word string, counts array<float>, n bigint")


@dataclass
class SkipGram:
    """What turns counts of contexts into a word's vector."""

    share: np.ndarray  # of each bucket in all contexts
    turn: np.ndarray  # BUCKETS x DIMENSIONS

    def information(self, counts: np.ndarray) -> np.ndarray:
        """Positive pointwise mutual information with each bucket."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(np.maximum(0, np.log(counts / np.maximum(1, counts.sum(-1, keepdims=True)) / self.share)), posinf=0)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = self.information(counts) @ self.turn
        return v / np.maximum(1e-9, np.linalg.norm(v, axis=-1, keepdims=True))

    def around(self, words: list[str]) -> np.ndarray:
        """The vector of a place with these words around it."""
        return self.vectors(np.bincount(_bucket(_hash(words)), minlength=BUCKETS).astype(np.float64)) if words else np.zeros(DIMENSIONS)

    @staticmethod
    def learn(counts: DataFrame) -> SkipGram:
        """From counts(word, counts, n): two sums of fixed size over all words reach the driver, one number and then one row a bucket."""

        def added(batches):
            total = np.zeros(BUCKETS)
            for batch in batches:
                total += _counted(batch.column(0)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], ["bucket", "n"])

        found = counts.select("counts").mapInArrow(added, "bucket bigint, n double").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
        share = np.ones(BUCKETS)
        share[[r[0] for r in found]] += [r[1] for r in found]
        model = SkipGram(share / share.sum(), np.zeros((BUCKETS, DIMENSIONS)))

        def products(batches):
            total = np.zeros((BUCKETS, BUCKETS))
            for batch in batches:
                m = model.information(_counted(batch.column(0)))
                total += m.T @ m
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array([r.tobytes() for r in total])], ["bucket", "row"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(r, np.float64) for r in table["row"].to_pylist())
            return pa.table({"bucket": [table["bucket"][0].as_py()], "row": [total.tobytes()]})

        whole = np.zeros((BUCKETS, BUCKETS))
        for r in counts.select("counts").mapInArrow(products, "bucket bigint, row binary").groupBy("bucket").applyInArrow(add, "bucket bigint, row binary").collect():
            whole[r[0]] = np.frombuffer(bytes(r[1]), np.float64)
        values, axes = np.linalg.eigh((whole + whole.T) / 2)
        top = np.argsort(values)[::-1][:DIMENSIONS]
        model.turn = axes[:, top] / np.maximum(1e-6, values[top]) ** 0.25
        return model


def _chosen(model: SkipGram):
    """The likeness of the contexts of a rare word and of what it may stand for, and the worth of the link."""

    def run(batches):
        for batch in batches:
            b = model.vectors(_counted(batch.column(6)))
            like = (model.vectors(_counted(batch.column(5))) * b).sum(1)
            df, edits, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 7))
            worth = like - 0.5 * edits + 0.2 * np.log(df)
            signs = np.array([bool(SIGN.search(w)) for w in batch.column(0).to_pylist()], bool)
            keep = pa.array((like > LIKE) | (n < CONTEXTS) | signs)
            v = pa.FixedSizeListArray.from_arrays(pa.array(b.astype(np.float32).ravel()), DIMENSIONS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(worth), v], ["rare", "word", "worth", "v"]).filter(keep)

    return run


def readings(docs: DataFrame, rules: Rules = RULES) -> tuple[DataFrame, SkipGram]:
    """(rare, options): what each misread word may stand for, the best by contexts, edits and frequency first (ties: the greater word), each with its vector if
    there are several; and the vectors' model."""
    linked = written(links(docs, rules), "links")
    counts = written(contexts(docs, linked), "contexts")
    model = SkipGram.learn(counts)
    a = counts.select(F.col("word").alias("rare"), F.col("counts").alias("ca"), F.col("n").alias("na"))
    b = counts.select("word", F.col("counts").alias("cb"))
    pairs = linked.join(a, "rare").join(b, "word").select("rare", "rare_df", "word", "df", "edits", "ca", "cb", "na")
    chosen = written(pairs.mapInArrow(_chosen(model), "rare string, word string, worth double, v array<float>"), "chosen")
    # what is a misreading itself is nobody's reading
    chosen = chosen.join(chosen.select(F.col("rare").alias("word")).distinct(), "word", "left_anti")
    capitals = F.col("rare").rlike("[0-9!@|$]") & (F.upper("rare") == F.col("rare"))
    found = chosen.select("rare", F.struct("worth", F.when(capitals, F.upper("word")).otherwise(F.col("word")).alias("word"), "v").alias("o"))
    # as many as frequent words share a skeleton with it
    options = F.sort_array(F.collect_list("o"), asc=False)
    several = F.transform("options", lambda o: F.struct(o["worth"].alias("worth"), o["word"].alias("word"), F.when(F.size("options") > 1, o["v"]).alias("v")))
    return found.groupBy("rare").agg(options.alias("options")).select("rare", several.alias("options")), model


#: A page's number: bare, in brackets, between dashes, after a short word, of so many.
NUMBERED = r"(?:[^\W\d_]{1,7}\.? )?\d{1,4}(?: ?/ ?\d{1,4}| ?\(\d{1,4}\))?"
PAGE = re.compile(rf"{NUMBERED}|[-–—]+ ?{NUMBERED} ?[-–—]+|\({NUMBERED}\)|\[{NUMBERED}\]")
# What stands before a page's number in the languages dealt with.
MARKED_PAGE = re.compile(r"[-–—]+ ?\d+ ?[-–—]+|(?:p|page|pág|página|seite|s|str|strona|стр|страница)\b", re.I)
END = re.compile(r"""[.!?:;…]["”»’)]*$""")
DRAWN = re.compile(r"[│┌┐└┘├┤┬┴┼─|]")


def furniture(lines: list[str], rules: Rules = RULES) -> set[int]:
    """Lines that are running headers or page numbers: short, between lines of text, and the same but for numbers; page numbers count up."""
    groups = defaultdict(list)
    for k, line in enumerate(lines):
        s = line.strip()
        if s and len(s) <= rules.short_line and not DRAWN.search(s):
            groups[NUMBER.sub("#", skeleton_of_header(s))].append(k)
    numbers, out = set(), set()
    for key, at in groups.items():
        if len(at) > 1 and "#" in key and sum(c.isalpha() for c in key) <= 8 and not END.search(key.rstrip(".")):
            values = [[int(x) for x in NUMBER.findall(lines[k])] for k in at]
            steps = [min((b - a for a, b in zip(x, y) if b > a), default=0) for x, y in zip(values, values[1:])]
            apart = all(any(lines[j].strip() for j in range(a + 1, b)) for a, b in zip(at, at[1:]))
            if apart and all(1 <= s <= 2 for s in steps):
                numbers |= set(at)
    for k, line in enumerate(lines):  # one alone: in the middle of a sentence, or marked as one at the end
        s = line.strip()
        if k and PAGE.fullmatch(s):
            before = next((x.strip() for x in reversed(lines[:k]) if len(x.strip()) >= rules.least_line), "")
            after = any(x.strip() for x in lines[k + 1 :])
            if before and len(before) <= rules.long_line and not DRAWN.search(before) and (after and not END.search(before) or not after and MARKED_PAGE.match(s)):
                numbers.add(k)
    for key, at in groups.items():
        if len(at) < 2 or set(at) & numbers or sum(c.isalpha() for c in key) < 3:
            continue
        text = lines[at[0]].strip()
        if END.search(text) or text[-1] == "," or text[0] in "-*•#" or ";" in text:
            continue
        between = [sum(len(lines[j]) > rules.least_line for j in range(a + 1, b)) for a, b in zip(at, at[1:])]
        if min(between) >= 1:
            out |= set(at)
    return out | numbers


def skeleton_of_header(s: str) -> str:
    """A header is misread here and there, its numbers are kept."""
    return "".join(c if c.isdigit() else STROKES.get(c, c) for c in s.lower())


def running(lines: list[str], rules: Rules = RULES) -> int:
    """How many lines end within a sentence and go on in the next, as lines of a page do."""
    return sum(1 for a, b in zip(lines, lines[1:]) if rules.least_line <= len(a.strip()) <= rules.long_line and b.strip() and not END.search(a.strip()) and not DRAWN.search(a))


def mend(word: str) -> str:
    """Signs within a word that is linked with none, as the letters they look like."""
    if INNER.search(word) and any(c.islower() for c in word):
        signs = {"1": "l", "!": "i", "|": "l", "0": "o", "@": "a", "9": "g", "5": "s", "8": "b", "6": "b", "$": "s"}
        if re.search("[а-яё]", word):
            signs |= {"0": "о", "@": "а"}
        return INNER.sub(lambda m: signs.get(m[0], m[0]), word)
    return word


#: Characters each side of a place that its context is looked for in.
REACH = 80


def best_here(options: list[dict], text: str, start: int, end: int, model: SkipGram | None) -> str:
    """The option whose vector, beside the worth of its link, is most like the words around the place."""
    if len(options) == 1 or model is None:
        return options[0]["word"]
    before = text[max(0, start - REACH) : start]
    around = model.around(WORD.findall(before)[-WINDOW:] + WORD.findall(text[end : end + REACH])[:WINDOW])
    begins = not before.strip() or bool(END.search(before.rstrip()))
    said = lambda o: o["worth"] + AT_PLACE * float(around @ np.asarray(o["v"])) + AT_START * (o["word"][0].isupper() == begins)
    return max(options, key=lambda o: (said(o), o["word"]))["word"]


def repair(text: str, fixes: dict[str, list[dict]], model: SkipGram | None = None, rules: Rules = RULES) -> tuple[str, bool]:
    """(text as continuous paragraphs, whether it carries traces of scanning). fixes: of a misread word the options (worth, word, v)."""
    lines = text.split("\n")
    if running(lines, rules) < rules.least_running:
        return text, False
    gone = furniture(lines, rules)
    if not (gone or fixes or INNER.search(text) or BREAK.search(text)):
        return text, False
    out: list[str] = []
    cuts, broken = 0, False
    for k, line in enumerate(lines):
        if k in gone:
            continue
        line = line.strip()
        if not line:
            # an empty line beside furniture ends no paragraph
            broken = broken or not ({k - 1, k + 1} & gone) or bool(out) and bool(END.search(out[-1]))
            continue
        cut = out and line[0].islower() and CUT.search(out[-1])
        if cut:
            cuts += 1
            out[-1] = out[-1][: cut.end() - 1] + line
        elif out and not broken:
            out[-1] += " " + line
        else:
            out.append(line)
        broken = False
    misread = 0

    def run(m):
        nonlocal misread

        def mended(w):
            nonlocal misread
            word = best_here(fixes[w[0]], m.string, m.start(), m.end(), model) if w[0] in fixes else mend(w[0])
            misread += word != w[0]
            return word

        if m[0].isalpha():
            return mended(m)
        if "@" in m[0] and DOMAIN.match(m.string, m.end()):
            return m[0]
        for form in forms(m[0]):
            if form in fixes:
                misread += 1
                before, _, after = m[0].partition(form)
                return before + best_here(fixes[form], m.string, m.start(), m.end(), model) + after
        return WORD.sub(mended, m[0])

    body = RUN.sub(run, "\n\n".join(out))
    if not (cuts or gone or misread):
        return text, False
    return SPECK.sub(" ", body), True


def scanned(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """id and repaired body of each row of docs(id, body) that carries traces of scanning: words cut at line ends, misread
    characters, running headers or page numbers between the lines.

    Null and empty bodies and texts not broken into lines of a page are none; rows with a null id are left out, ids are unique; other
    columns are ignored; an empty table gives no rows.

    Words are counted and skip-gram contexts added up over all documents; only pages, texts whose lines run on, are then
    taken apart, each with the readings of its own words, of which the words around each place choose. A page's traces in its layout, and signs within
    words, count without a vector.
    """
    rows = spread(docs.where(F.col("id").isNotNull() & (F.length("body") > 0)).select("id", "body"), "id")
    options, model = readings(rows, rules)
    known = written(options, "readings")
    # a superset of running(), which decides
    pages = written(rows.where(F.col("body").rlike(r"\n(?<=[^\s.!?:;…][ \t\r]{0,2}\n)(?=[ \t]*\S)")))
    # a superset of words_of(), which decides
    every = lambda pattern: F.regexp_extract_all("body", F.lit(pattern), F.lit(0))
    runs = every(r"(?<![\p{L}0-9!@|$])\p{L}*+[0-9!@|$][\p{L}0-9!@|$]*+")
    bare = lambda pattern: F.transform(runs, lambda r: F.regexp_replace(r, pattern, ""))
    forms_ = F.concat(every(r"\p{L}+(?:[0-9!@|$]\p{L}+)*"), runs, bare(r"[!|]+$"), bare(r"^[!|]+|[!|]+$"))
    words = pages.select("id", F.explode(F.array_distinct(forms_)).alias("rare"))
    # the spellings alone first: they are few and small, and nearly all words of a page are none of them
    misread = words.join(known.select("rare"), "rare", "left_semi")
    fixes = misread.join(known, "rare").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("rare", "options"))).alias("fixes"))

    def run(batches):
        for batch in batches:
            out = [(i, *repair(t, dict(f or []), model, rules)) for i, t, f in zip(*(c.to_pylist() for c in batch.columns))]
            hits = [x for x in out if x[2]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in hits], batch.schema.field(0).type), pa.array([x[1] for x in hits], pa.string())], ["id", "body"])

    return pages.join(fixes, "id", "left").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, body string")

"""Text decoded with the wrong character encoding: found, and restored where it can be.

A best-first search over texts and byte strings: a text can be encoded by a page or unescaped, a byte string decoded by one. Every unseen
state is queued, states are kept once by hash, and the cheapest by a character-plausibility cost is taken first; the cheapest text
reached is the answer. The search ends at a text that is no longer odd, or when the queue is empty; it holds what STEPS wrong decodings
can make of texts that cost at most UPHILL times the first.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.session import spread

#: Code pages of one byte a character; undefined bytes stand for the control character of the same number.
PAGES = ("cp1252", "latin_1", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman", "mac_cyrillic", "iso8859_2", "iso8859_5", "iso8859_15", "cp1253", "cp1254", "cp1257")
WIDE = ("utf_16_le", "utf_16_be")
#: Pages of two bytes a character. They read almost any bytes as letters that could be meant, so only what then decodes as UTF-8 counts against them.
DOUBLE = ("gbk", "shift_jis", "big5", "euc_kr")
#: Wrong decodings in a row that are undone; a text may cost so many times the first and still be looked into.
STEPS, UPHILL = 2, 1.25
#: What each wrong decoding after the first counts, so that one explains a stretch before two do.
STEP_COST = 1.0
#: A restored stretch costs at most this share of what it cost, and less by at least GAIN.
SHARE, GAIN = 0.6, 1.5
#: Priority of a text that came out of UTF-8, against its cost.
UTF8_FIRST = 0.3
#: A stretch that is less odd is not searched.
SUSPECT = 1.5

# Letters with marks that the languages of Europe use often, and signs that stand beside words.
USUAL = frozenset("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœąćęłńśźżčďěňřšťůžőűğışăâîșțÀÁÂÃÄÅÆÇÈÉÊËÍÎÏÑÓÔÕÖØÚÛÜÝŒĄĆĘŁŃŚŹŻČĎĚŇŘŠŤŮŽŐŰĞİŞĂȘȚ")
QUOTES = frozenset("“”‘’„‚«»‹›–—…‐‑−•·")
BEFORE_WORD = frozenset("¿¡“‘„‚«‹–—•·§€£©…‐‑#°±½¼¾µ")
#: Of the letters above those that need no second thought.
FREQUENT = frozenset("àâäãçèéêíñóôõöùúûüßáąćęłńśźżÀÁÂÃÄÇÈÉÊÍÑÓÔÕÖÚÜĄĆĘŁŃŚŹŻ")
AFTER_WORD = frozenset("”’»›…–—‐‑·•©®™°²³\xad¬€£%§ªº")
#: A byte order mark in UTF-8 that was read as a western page.
BOM = "ï»¿"
POLISH = frozenset("ąćęłńóśźż")

#: What is never meant: the character for a lost one, and control characters beyond ASCII.
LOST = re.compile("[\ufffd\x80-\x9f]")
TOKEN = re.compile(r"[^ \t\n\r\f\v\u3000]+")


def _tables():
    decode = {}
    for page in PAGES:
        decode[page] = "".join(bytes([b]).decode(page, "replace").replace("�", chr(b)) for b in range(256))
    encode = {page: {c: b for b, c in reversed(list(enumerate(t)))} for page, t in decode.items()}
    for page in ("cp1252", "cp1250", "cp1251"):  # control characters that a strict reader left
        for b in range(0x80, 0xA0):
            encode[page].setdefault(chr(b), b)
    return decode, encode


DECODE, ENCODE = _tables()


@lru_cache(maxsize=65536)
def _kind(c: str) -> str:
    """a: ASCII; L: Latin letter with a mark; C, G: Cyrillic, Greek; O: other letter; D: other digit; Q: typographic sign; S: symbol; X: never meant."""
    o = ord(c)
    if o < 128:
        return "a" if o >= 32 or c in "\t\n\r" else "X"
    if 0xFB00 <= o <= 0xFB06:  # ligatures of ASCII letters
        return "a"
    if c == "�" or 0x80 <= o < 0xA0 or unicodedata.category(c) in ("Co", "Cn", "Cs", "Cc"):
        return "X"
    if c in QUOTES:
        return "Q"
    category = unicodedata.category(c)
    if category[0] == "L" and c not in "ªº":
        name = unicodedata.name(c, "")
        if name.startswith("LATIN"):
            return "L"
        if name.startswith("CYRILLIC"):
            return "C"
        if name.startswith("GREEK") and c != "µ":
            return "G"
        return "S" if c == "µ" else "O"
    if category[0] == "M":
        return "M"
    return "D" if category == "Nd" else "S"


@lru_cache(maxsize=400_000)
def plausibility(token: str) -> tuple[float, float]:
    """(cost, part of it that is odd): how implausible the characters of a word are beside each other; 0 for ASCII."""
    base, odd, n = 0.0, 0.0, len(token)
    letters = [i for i, c in enumerate(token) if c.isalpha() and c not in "ªºµ"]
    first, last = (letters[0], letters[-1]) if letters else (n, 0)
    for i, c in enumerate(token):
        k = _kind(c)
        if k == "a" and (c.islower() or not i):
            continue
        before, after = token[i - 1] if i else "", token[i + 1] if i + 1 < n else ""
        kb, ka = _kind(before) if before else "", _kind(after) if after else ""
        letter_before = before.isalpha() and kb != "S"
        letter_after = after.isalpha() and ka != "S"
        if k == "a":  # what wide characters fall apart into when they were meant
            if before.isalnum() and before.isascii() and (c.isupper() and before.islower() or c.isdigit() != before.isdigit() or c in "{}|<>\\^~`" or before in "{}|<>\\^~`"):
                odd += 0.4
        elif k == "X":
            odd += 5
        elif k == "L":
            base += 0.35 if c in FREQUENT else 0.5
            if c not in USUAL:
                odd += 0.8
            if kb == "L":
                three = token[max(0, i - 2) : i + 1]
                if len(three) == 3 and _kind(three[0]) == "L" and not set(three.lower()) <= POLISH:
                    odd += 1.4
                else:
                    odd += 0.1 if before in FREQUENT and c in FREQUENT else 0.4
            if kb in ("C", "G", "O"):
                odd += 3
            if c.isupper() and letter_before and before.islower():
                odd += 2
            if ka in ("S", "X") and (after not in "¬\xad" or c in "ÃÂ") or ka == "Q" and after not in AFTER_WORD or ka == "Q" and c in "ÃÂâÐÑ" and after not in "’”–—…»":
                odd += 2
        elif k == "C":
            base += 0.25
            if not ("А" <= c <= "я" or c in "ёЁ"):
                odd += 0.95
            if kb in ("L", "G", "O") or kb == "a" and letter_before or ka == "a" and letter_after:
                odd += 3
            if letter_before and kb == "C" and c.isupper():
                base += 0.15
                odd += 2 * before.islower()
            if kb == "C" and ka == "C" and c.lower() == "ъ" and before.lower() in "аоуыэяюиеьъ":
                odd += 1.5
        elif k == "G":
            base += 0.5
            if kb in ("L", "C", "O") or kb == "a" and letter_before:
                odd += 2.5
            if ka == "L" or ka == "a" and letter_after:
                odd += 2.5
        elif k == "O":
            base += 0.5
            odd += 0.3
            if kb == "a" and letter_before or ka == "a" and letter_after:
                odd += 1.5
        elif k == "M":
            if letter_before and "\u0300" <= c <= "\u0304":
                base += 1
            else:
                odd += 2
        elif k == "Q":
            base += 0.1 if c in "“”’–—" else 0.4
            if letter_before and letter_after and c not in "’‐‑":
                odd += 2 if c not in "–—…·" else 1
            elif letter_before and c not in AFTER_WORD or letter_after and not letter_before and c not in BEFORE_WORD and c != "’":
                odd += 1.5
            if kb == "L" and before in "âÃÂ":
                odd += 1
        elif k == "D":
            base += 1
        else:  # symbols
            if c == "\ufeff" and not i:
                continue
            base += 0.3
            if c == "\xad" and not after:
                continue
            if letter_before and letter_after and c != "\xad":
                odd += 3
            elif first < i < last and not "-" in token[first:last]:
                odd += 1.5
            elif letter_before and c not in AFTER_WORD or letter_after and c not in BEFORE_WORD:
                odd += 2.2
            drawn = "─" <= c <= "▟"
            if drawn and (kb == "S" and not "─" <= before <= "▟" or ka in ("S", "L") and not "─" <= after <= "▟"):
                odd += 2
            if unicodedata.category(c) == "Cf" and c != "\xad":
                odd += 2
    return base + odd, odd


def cost(token: str) -> float:
    return plausibility(token)[0]


@lru_cache(maxsize=400_000)
def _encoded(token: str, page: str) -> bytes | None:
    table = ENCODE.get(page)
    if table is None:
        if page in DOUBLE and not RUN_OF_TWO.search(token):
            return None
        try:
            return token.encode(page)
        except UnicodeError:
            return None
    out = [table.get(c) for c in token]
    return None if None in out else bytes(out)


@lru_cache(maxsize=400_000)
def _decoded(raw: bytes, page: str) -> str | None:
    if page not in DECODE:
        try:
            return raw.decode(page)
        except UnicodeError:
            if page == "utf_8" and 0xC3 <= raw[-1] <= 0xD1 and len(raw) > 1:  # its last byte was a no-break space, which became the blank after it
                return _decoded(raw + b"\xa0", page)
            return None
    table = DECODE[page]
    return "".join(table[b] for b in raw)


#: Letters of the east, which a page of two bytes a character makes of others.
RUN_OF_TWO = re.compile(r"[\u2e80-\ud7a3\uf900-\ufaff\uff61-\uff9f]")
#: What two bytes of ASCII or more make when read as one character.
RUN = re.compile(r"[\u0a0a-\u0a7e\u0d0a-\u0d7e\u2000-\uffff]{3,}")


@lru_cache(maxsize=100_000)
def _narrowed(run: str, source: str, target: str) -> str:
    """Wide characters fallen apart, if what they hold reads as text: few changes between letters and digits."""
    raw = _encoded(run, source)
    out = raw and _decoded(raw, target)
    if not out or target in WIDE:
        return out or run
    mixed = sum(a.isdigit() and b.isalpha() or a.isalpha() and b.isdigit() for a, b in zip(out, out[1:]))
    plain = sum(c.islower() or c.isspace() or c.isdigit() for c in out)
    return out if mixed <= 0.15 * len(out) and plain >= 0.7 * len(out) and sum(c.isascii() for c in out) >= 0.7 * len(out) else run


def _bytes(token: str, page: str) -> bytes | str:
    """The word in a page's bytes; as it is where the page has not all of its characters."""
    raw = _encoded(token, page)
    return token if raw is None else raw


def _text(raw: bytes | str, page: str) -> str:
    """A byte string read by a page; a word that was not encoded stays, and so does one that the page can't read (by the page it came from)."""
    return raw if isinstance(raw, str) else _decoded(raw, page)


#: Pages that texts were read as: the code pages of western, central European and Russian systems, and those they then were written in.
READ = ("cp1252", "latin_1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "koi8_r", "mac_roman", "mac_cyrillic", "iso8859_2")
WRITTEN = ("utf_8", "cp1252", "cp1250", "cp1251", "koi8_r", "cp866", "mac_roman", "iso8859_2", "cp437", "cp850")
#: By page that a text is encoded in: the pages that its bytes are decoded by.
COMMON = {a: WRITTEN if a in READ else ("utf_8",) for a in (*PAGES, *DOUBLE)}
#: Every page's bytes by every other: each such step counts as so much more cost, so pages that differ in a few signs only are not taken for common ones.
SELDOM = {a: tuple(b for b in PAGES if b != a and b not in COMMON[a]) for a in PAGES}
SELDOM_COST = 0.5
#: Wide characters fall apart within a word: only the foreign part of it is encoded.
APART = {a: ("utf_8", "cp1252", "utf_16_be" if a == "utf_16_le" else "utf_16_le") for a in WIDE}


def _state(tokens: tuple) -> int:
    """A string's hash is that of its bytes, so wide characters and what they fall apart into need their lengths and kinds."""
    return hash((tokens, *map(len, tokens), *map(type, tokens)))


def _spent(t: str) -> bool:
    """A lost character is in no page: the word stays as it is on every way."""
    return "\ufffd" in t


def restore(tokens: tuple[str, ...], steps: int = STEPS, uphill: float = UPHILL) -> tuple[tuple[str, ...], float, float]:
    """The cheapest reading of a stretch's words, its cost, and the cost before. What the seldom pages make of it stands if it is cheaper by
    what its steps to them cost and much less odd, and mends more words than it harms; a word whose bytes are lost would draw the others with it. A reading that is not odd
    needs no second search."""
    first = sum(map(cost, tokens))
    best, best_cost, worth = _search(tokens, False, steps, uphill)
    if odd := sum(plausibility(t)[1] for t in best if not _spent(t)):
        other, other_cost, other_worth = _search(tokens, True, steps, uphill)
        mended = sum(0 < plausibility(a)[1] and plausibility(b)[1] <= (1 - SHARE) * plausibility(a)[1] for a, b in zip(best, other))
        harmed = sum(plausibility(a)[1] == 0 and cost(b) > cost(a) + 1e-9 for a, b in zip(best, other))
        left = sum(plausibility(b)[1] for a, b in zip(best, other) if not _spent(a))
        if mended > harmed and other_worth < worth - 1e-9 and left <= (1 - SHARE) * odd:
            best, best_cost = other, other_cost
    return best, best_cost, first


def _ways(state: tuple, source: str, seldom: bool):
    """(page, cost of the step, text) that a byte string can be read as."""
    for more, pages in ((0.0, COMMON[source]), (SELDOM_COST, SELDOM.get(source, ()) if seldom else ())):
        for page in pages:
            if page == "utf_8":  # words that are no UTF-8 stay what they were
                yield page, more, tuple(t if isinstance(t, str) else u if (u := _decoded(t, page)) is not None else _decoded(t, source) for t in state)
            else:
                yield page, more, tuple(_text(t, page) for t in state)


def _search(tokens: tuple[str, ...], seldom: bool, steps: int, uphill: float) -> tuple[tuple[str, ...], float, float]:
    """The best reading found, its cost, and that with its seldom steps."""
    first = sum(map(cost, tokens))
    first_odd = sum(plausibility(t)[1] for t in tokens if not _spent(t))
    best, best_cost, best_worth = tokens, first, first
    # a text: its rank, a number, its cost, the cost of seldom steps, wrong decodings undone; a byte string also the page it is in
    heap: list[tuple] = [(first, 0, first, 0.0, 0, "", tokens)]
    seen: dict = {_state(tokens): 0.0}
    order = 0

    def reached(new: tuple, extra: float, made: int, surely: bool) -> None:
        nonlocal order, best, best_cost, best_worth
        if seen.get(h := _state(new), extra + 1) <= extra:
            return
        seen[h] = extra
        new_cost = sum(map(cost, new))
        if new_cost + extra < best_worth - 1e-9:
            best, best_cost, best_worth = new, new_cost, new_cost + extra
        if new_cost <= uphill * first and made <= steps:
            order += 1
            # what decodes as UTF-8 seldom does so by chance: it is looked into first
            heapq.heappush(heap, (new_cost * (UTF8_FIRST if surely else 1) + extra, order, new_cost, extra, made, "", new))

    while heap:
        rank, _, c, extra, made, source, state = heapq.heappop(heap)
        if source:
            for page, more, new in _ways(state, source, seldom):
                reached(new, extra + more + STEP_COST * bool(made), made + 1, page == "utf_8")
            continue
        if c < first and sum(plausibility(t)[1] for t in state if not _spent(t)) <= 0.05 * first_odd:
            break
        if made == steps:
            continue
        reached(tuple(map(html.unescape, state)), extra, made, False)
        for page, pages in APART.items():
            if any(RUN.search(t) for t in state):
                for target in pages:
                    reached(tuple(RUN.sub(lambda m: _narrowed(m[0], page, target), t) for t in state), extra + STEP_COST * bool(made), made + 1, target == "utf_8")
        for page in COMMON:
            raw = tuple(_bytes(t, page) for t in state)
            key = _state(raw), page in READ, page in DOUBLE
            if any(type(t) is bytes for t in raw) and seen.get(key, extra + 1) > extra:
                seen[key] = extra
                order += 1
                heapq.heappush(heap, (float("-inf"), order, c, extra, made, page, raw))  # bytes are no dearer than what they are read as
    return best, best_cost, best_worth


def _accepted(tokens: tuple[str, ...], steps: int, uphill: float) -> dict[str, str]:
    """What is changed in a stretch, if its cheapest reading is better by enough."""
    best, after, before = restore(tokens, steps, uphill)
    odd = sum(plausibility(t)[1] for t in tokens)
    left = sum(plausibility(t)[1] for t in best)
    if before - after < GAIN or after > SHARE * before and left > (1 - SHARE) * odd:
        return {}
    return {a: b for a, b in zip(tokens, best) if a != b}


#: A character written as a reference.
ESCAPED = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]+);")
#: Wide text read as a page of one byte a character: every other character is a zero.
ZEROS = re.compile(r"(?:[^\x00]\x00){3,}[^\x00]?|(?:\x00[^\x00]){3,}\x00?")


def _unzeroed(m: re.Match) -> str:
    """What a stretch with zeros between is as wide text, in the byte order that leaves the plainer one."""
    raw = bytes(ord(c) if ord(c) < 256 else 0x3F for c in m[0])
    ways = [raw[: len(raw) // 2 * 2].decode(page, "replace") for page in WIDE]
    best = min(ways, key=lambda t: (sum(map(cost, TOKEN.findall(t))), -sum(c.isascii() for c in t)))
    return best if "\x00" not in best else m[0]


def repair(text: str, steps: int = STEPS, uphill: float = UPHILL) -> tuple[str, bool]:
    """(restored text, whether a stretch was garbled). A stretch is a line's words that hold a character beyond ASCII or a reference to one, or
    what has a zero at every other place. References alone are no case: only what they stand for can be garbled."""
    if text.isascii() and "&" not in text and "\x00" not in text:
        return text, False
    bare = ZEROS.sub(_unzeroed, text) if "\x00" in text else text
    found = BOM in text or bare != text
    lines = bare.replace(BOM, "").split("\n")
    for i, line in enumerate(lines):
        if line.isascii() and "&" not in line:
            continue
        tokens = [t for t in TOKEN.findall(line) if not t.isascii() or ESCAPED.search(t)]
        plain = {t: html.unescape(t) if "&" in t else t for t in tokens}
        if sum(plausibility(plain[t])[1] for t in tokens) >= SUSPECT:
            suspects = tuple(dict.fromkeys(plain[t] for t in tokens))
            changed = _accepted(suspects, steps, uphill)
            if not changed:  # a stretch may be one word among clean ones
                for t in suspects:
                    if plausibility(t)[1] >= SUSPECT:
                        changed |= _accepted((t,), steps, uphill)
            if changed:
                lines[i] = TOKEN.sub(lambda m: changed.get(plain.get(m[0], m[0]), m[0]), line)
                found = True
        if LOST.search(line):
            found = True
    return "\n".join(lines), found


def garbled(docs: DataFrame, steps: int = STEPS, uphill: float = UPHILL) -> DataFrame:
    """id and restored body of each row of docs(id, body) with at least one stretch that was decoded with a wrong encoding and shows it;
    where the original is lost the characters that stand for it stay. steps and uphill bound the search, see STEPS.

    Null and empty bodies and pure ASCII without references or zeros are never garbled; a null id is kept; repeated rows give a row each; other
    columns are ignored; an empty table gives no rows. Rows are independent: no shuffle, and such ASCII texts never leave the JVM.
    """

    def run(batches):
        for batch in batches:
            out = [(i, *repair(t, steps, uphill)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            hits = [(i, t) for i, t, found in out if found]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], batch.schema.field(0).type), pa.array([h[1] for h in hits], pa.string())], ["id", "body"])

    rows = spread(docs.where(F.col("body").rlike("[^\\x01-\\x7f]|&(?:#\\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]+);")).select("id", "body"), "id")
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, body string")

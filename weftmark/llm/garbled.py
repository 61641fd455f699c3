"""Garbled text from wrong character encoding: finding and restoring.

1. Adjacent character pairs are counted over all documents (partial counts leave each task). Rare scripts
   share classes, so the table has at most 2336 x 2336 entries, whatever the corpus. Stretches that are
   valid UTF-8 once read back through some single-byte encoding are counted neither way: what is to be found
   should not teach the model.
2. A pair's score is the log of its term of the corpus mutual information, p(a, b) log p(a, b) / p(a) p(b).
   Maximum-scoring segments of improbability isolate runs; texts without runs are done.
3. Inside runs inverse mappings are tested: UTF-8 read as a single-byte encoding (also more than once),
   East Asian encodings likewise, and one single-byte encoding read as another. A mapping holds if what it
   gives is more probable, in bits, under the corpus' pair model, by a margin where it keeps the length.
4. UTF-8 read as a two-byte encoding gives East Asian letters, which share a class and make no improbable
   run; every stretch that is UTF-8 once encoded again is tried, at a price for each letter of a shared class.

U+FFFD is itself the mark of wrong decoding; such text is found, and stays as it is. So are C1 controls beside
letters, and sequences that are UTF-8 read as Windows or ISO Latin 1 beyond doubt although no mapping gains.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.lookalike import SHAPES

SIZE = 2336
OTHER = 2288
# Code point ranges that keep one class a character, in order, from class 1536 on.
KEPT = ((0x2000, 0x2070), (0x20A0, 0x20D0), (0x2100, 0x2150), (0x2500, 0x2600), (0x2200, 0x2300))
# Ranges that share a class.
SHARED = ((0x3040, 0x30A0), (0x30A0, 0x3100), (0x3000, 0x3040), (0x3400, 0xA000), (0xAC00, 0xD7B0), (0xFF00, 0xFFF0), (0xFFFD, 0xFFFE), *((b, b + 0x100) for b in range(0x0600, 0x2000, 0x100)), (0x1F000, 0x20000), (0xE000, 0xF900))
# Encodings as which UTF-8 is misread.
MISREAD = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8-r", "mac_cyrillic", "iso8859-2", "iso8859-5", "iso8859-7")
# Fixed values: (misread as, true encoding) of one byte a character.
SWAPS = (
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1252", "mac_cyrillic"), ("cp1252", "cp1253"), ("cp1252", "iso8859-5"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("cp1251", "mac_cyrillic"), ("cp1251", "iso8859-5"),
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac_roman", "cp437"), ("cp437", "mac_roman"),
    ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp1253", "cp1252"), ("cp437", "cp866"), ("cp1251", "mac_roman"), ("cp866", "cp1252"), ("koi8-r", "cp1252"),
)
EAST = ("euc_jp", "shift_jis")
# Two-byte encodings as which UTF-8 is misread.
WIDE_READ = ("gbk", "cp932", "big5", "euc_jp", "cp949")
LATIN_READ = ("cp1252", "mac_roman", "cp437", "cp1251", "cp850")
MARGIN = 15.0  # bits by which a mapping that keeps the length must gain
SEQUENCE_MARGIN = 4.0  # bits by which a misread UTF-8 sequence must gain
RARE_ENCODING = 3.0  # bits more that readings through the encodings after the first two must gain
KNOWN = 2e-7  # share of all characters from which a class counts as one the corpus uses,
KNOWN_LEAST = 2  # or as many occurrences, however large the corpus
LEVEL = -16.0  # log2 of a pair's term of the mutual information at which it is neither probable nor improbable
LEAST_RUN = 3.0
STRAY = 20.0  # bits more that a sequence must gain in a word with other characters that would be stray bytes
LEAST_WORD = 4.0  # bits by which a further word must gain from a swap that holds elsewhere in its text
MARKS = ".,:;!?\"'()"
BLANKS = " \n\t\r"
# words that are not ASCII, tried at the starts of words only
FOREIGN = re.compile("(?<![^ \\n\\t\\r])[^ \\n\\t\\r\x80-\U0010ffff]*+[^\x00-\x7f][^ \\n\\t\\r]*")
HIGH = re.compile(r"[^\x00-\x7f]")
EAST_LETTER = re.compile("[\u2e80-\u9fff\uac00-\ud7a3]")
KANA = re.compile("[ぁ-ヾ]")
WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7a3\uff61-\uff9f]")
NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
SEQUENCES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
WIDE_BITS, KANA_BITS = 8.0, 5.0  # what a letter of a shared class costs beside its class


def _class_table() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.int32)
    for k, (low, high) in enumerate(SHARED):
        out[low:high] = OTHER + 1 + k
    out[:1536] = np.arange(1536)
    at = 1536
    for low, high in KEPT:
        out[low:high] = np.arange(at, at + high - low)
        at += high - low
    return out


_CLASS = _class_table()
_LETTER = np.array([chr(p).isalpha() for p in [*range(1536), *(p for low, high in KEPT for p in range(low, high))]] + [True] * (SIZE - OTHER))


_ASCII_LETTER = np.zeros(SIZE, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def classes_of(points: np.ndarray) -> np.ndarray:
    """Class of each code point."""
    return _CLASS[points]


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@cache
def byte_table(encoding: str) -> dict[str, int]:
    """Character to byte, for bytes from 0x80; bytes without a character stand for the control of their number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        out[ch] = b
    return out


class Misreading:
    """UTF-8 read as one encoding: where it can be, and what it was."""

    def __init__(self, encoding: str):
        self.bytes = byte_table(encoding)
        chars = {b: ch for ch, b in self.bytes.items()}

        def group(low: int, high: int) -> str:
            return "[" + "".join(re.escape(chars[b]) for b in range(low, high + 1) if b in chars) + "]"

        self.leads = {chars[b] for b in range(0xC2, 0xF5) if b in chars}
        self.others = {chars[b] for b in range(0x80, 0xC0) if b in chars}
        more = group(0x80, 0xBF)
        self.pattern = re.compile(f"(?:{group(0xC2, 0xDF)}{more}|{group(0xE0, 0xEF)}{more}{more}|{group(0xF0, 0xF4)}{more}{more}{more})+")

    def undo(self, text: str) -> str | None:
        try:
            return bytes(self.bytes[ch] for ch in text).decode("utf-8")
        except UnicodeDecodeError:
            return None


@cache
def misreadings() -> list[Misreading]:
    return [Misreading(e) for e in MISREAD]


@cache
def _mark_tables() -> tuple[np.ndarray, ...]:
    """By code point, one bit an encoding of MISREAD: leads of two, three and four bytes, and continuations."""
    tables = tuple(np.zeros(0x110000, dtype=np.uint32) for _ in range(4))
    for k, encoding in enumerate(MISREAD):
        for ch, b in byte_table(encoding).items():
            for table, low, high in zip(tables, (0xC2, 0xE0, 0xF0, 0x80), (0xE0, 0xF0, 0xF5, 0xC0)):
                if low <= b < high:
                    table[ord(ch)] |= np.uint32(1 << k)
    return tables


def sequence_marks(points: np.ndarray) -> np.ndarray:
    """For each position the bits of the encodings as which a UTF-8 sequence misread may start there."""
    two, three, four, more = _mark_tables()
    n = len(points)
    if n < 2:
        return np.zeros(n, dtype=np.uint32)
    m = np.concatenate([more[points[1:]], np.zeros(3, dtype=np.uint32)])
    pair = m[:n] & m[1 : n + 1]
    return (two[points] & m[:n]) | (three[points] & pair) | (four[points] & pair & m[2 : n + 2])


AGAIN = frozenset().union(*(t.bytes for t in misreadings()))  # characters that some byte is read as
LEADS = frozenset().union(*(t.leads for t in misreadings()))


def tools_of(bits: int) -> list[tuple[Misreading, float]]:
    """Misreadings of the given bits, with the bits more that each must gain."""
    return [(t, RARE_ENCODING * (k > 1)) for k, t in enumerate(misreadings()) if bits >> k & 1]


@cache
def swaps() -> list[dict[int, str]]:
    """Translation tables of the single-byte pairs."""
    tables = []
    for read, true in SWAPS:
        to = {b: ch for ch, b in byte_table(true).items()}
        tables.append({ord(ch): to[b] for ch, b in byte_table(read).items() if to.get(b, ch) != ch})
    return tables


@cache
def high_runs(read: str, true: str) -> re.Pattern:
    """Stretches of six or more characters that are bytes of a two-byte encoding, read as ``read``."""
    high = "".join(map(re.escape, byte_table(read)))
    return re.compile(f"[{high}][{high}{'@-~' if true == 'shift_jis' else ''}]{{5,}}")


# what the first bytes of kana in the two encodings are read as
EAST_LEADS = re.compile("[" + "".join(sorted({re.escape(bytes([b]).decode(read)) for read in LATIN_READ for b in (0x82, 0x83, 0xA4, 0xA5)})) + "]")
DENSE = re.compile(r"(?:[^\x00-\x7f][@-~]*){6,}")  # what bytes of at least six high ones in a row of such an encoding can give
NATURAL = re.compile(r"[^\W\d_]+")


RAW = re.compile("[^ \\n\\t\\r]*[\\x80-\\x84\\x86-\\x9f][^ \\n\\t\\r]*|[\\x80-\\xff]{6,}")


def natural_word(span: str) -> bool:
    """Letters alone, without a capital behind a small letter: more likely a word than misread bytes."""
    return bool(NATURAL.fullmatch(span)) and not any(x.islower() and y.isupper() for x, y in zip(span, span[1:]))


def suspicious_spans(text: str, bits: int | None = None) -> list[tuple[int, int]]:
    """Spans that are UTF-8 read through some encoding and no plain words, words with C1 controls, and long
    stretches from U+0080 to U+00FF; merged and in order. ``bits``: the encodings, where the caller knows them."""
    if bits is None:
        bits = int(np.bitwise_or.reduce(sequence_marks(points_of(text)), initial=0))
    spans = sorted({m.span() for tool, _ in tools_of(bits) for m in tool.pattern.finditer(text) if not natural_word(m.group())} | {m.span() for m in RAW.finditer(text)})
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


STRAY_CONTROL = re.compile("[^\\W\\d_][\x80-\x84\x86-\x9f]|[\x80-\x84\x86-\x9f][^\\W\\d_]")


def evident(text: str) -> bool:
    """Whether a text holds C1 controls beside letters, or misread UTF-8 of two sequences or one of three bytes."""
    if STRAY_CONTROL.search(text):
        return True
    latin = misreadings()[:2]
    spans = (m.group() for tool in latin if not tool.leads.isdisjoint(text) for m in tool.pattern.finditer(text))
    return any(len(span) > 2 and not natural_word(span) and any(tool.undo(span) is not None for tool in latin if set(span) <= tool.bytes.keys()) for span in spans)


def _slices(texts: pd.Series, most: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in order, in lists of about ``most`` characters, so that arrays over a list stay small."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


class Batch:
    """Code points of many texts in one array: a line end before and behind each, the same one or, with ``gap`` 2, two."""

    def __init__(self, texts: list[str], gap: int = 1):
        self.points = points_of("\n" + ("\n" * gap).join(texts) + "\n")
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.starts = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]]) + 1
        self.ends = self.starts + sizes
        self.marks = sequence_marks(self.points)

    def raw_marks(self) -> np.ndarray:
        """1 where a C1 control stands or six characters from U+0080 to U+00FF begin."""
        p = self.points
        control = (p >= 0x80) & (p < 0xA0) & (p != 0x85)
        high = np.concatenate([[0], np.cumsum((p >= 0x80) & (p < 0x100))])
        six = np.zeros(len(p), dtype=bool)
        six[: len(p) - 5] = high[6:] - high[:-6] == 6
        return (control | six).astype(np.uint32)

    def any_bits(self, marks: np.ndarray) -> np.ndarray:
        """Bits set anywhere in each text."""
        return np.bitwise_or.reduceat(marks, self.starts - 1) if len(self.starts) else np.zeros(0, dtype=np.uint32)


def pair_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(pair, n): adjacent pairs of classes over all texts; pair = a * SIZE + b, a text's ends count as line ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | None = None
        for batch in batches:
            for texts in _slices(batch["text"]):
                whole = Batch(texts)
                c = classes_of(whole.points)
                pair = c[:-1] * SIZE + c[1:]
                kept = np.ones(len(pair), dtype=bool)
                bits, raw = whole.any_bits(whole.marks), whole.any_bits(whole.raw_marks())
                for i in np.flatnonzero(bits | raw):
                    for x, y in suspicious_spans(texts[i], int(bits[i])):
                        x, y = x + whole.starts[i], y + whole.starts[i]
                        kept[x - 1 : y] = False  # the pairs of the span's characters and the two at its ends
                counted = np.bincount(pair[kept])
                if total is None:
                    total = np.zeros(SIZE * SIZE, dtype=np.int64)
                total[: len(counted)] += counted
        if total is not None:
            pairs = np.flatnonzero(total)
            yield pd.DataFrame({"pair": pairs, "n": total[pairs]})

    return df.select(F.col(text).alias("text")).filter("text <> ''").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


NOTHING = np.full(len(SWAPS), -MARGIN, dtype=np.float32)


class PairModel:
    """Conditional pair probabilities and terms of the mutual information, in bits."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        table = np.zeros((SIZE, SIZE), dtype=np.float32)
        table.reshape(-1)[pairs] = counts
        total = max(float(table.sum(dtype=np.float64)), 1.0)
        left = table.sum(axis=1, dtype=np.float64)
        right = (table.sum(axis=0, dtype=np.float64) + total * 1e-7) / (total * (1 + 1e-7 * SIZE))
        self.known = left >= min(KNOWN * total, KNOWN_LEAST)
        prior = 20.0 + total * 1e-6
        self.cond = np.log2((table + prior * right) / (left[:, None] + prior)).astype(np.float32)
        joint = table / total
        base = np.maximum(left / total, 1e-12)[:, None] * np.maximum(right, 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            info = joint * np.log2(joint / base)
            self.info = np.where(info > 2.0**-40, np.log2(info), -40.0).astype(np.float32)
        self.kept: dict[str, tuple[float, np.ndarray]] = {}
        self.uses: dict[bytes, bool] = {}
        self.starts: dict[str, bool] = {}
        self.won: dict[tuple[str, str, str, str], float] = {}
        self.read: dict[tuple, tuple[str, float] | None] = {}

    def bits(self, text: str) -> float:
        """Log probability of a text, its first character given."""
        c = classes_of(points_of(text))
        return float(self.cond[c[:-1], c[1:]].sum(dtype=np.float64))

    def height(self, points: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """Height of the improbable segments before each character. ``ends``: line ends before another, at which it falls to nothing."""
        c = classes_of(points)
        wide = (points[:-1] > 127) | (points[1:] > 127)
        score = np.full(len(wide), -1.0)
        at = np.flatnonzero(wide)
        score[at] = np.clip((LEVEL - self.info[c[at], c[at + 1]]) / 2, -3.0, 4.0)
        if ends is not None:
            score[ends] = -1e5  # over any height that a text in range can reach
        total = np.concatenate([[0.0], np.cumsum(score)])
        return total - np.minimum.accumulate(total)

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Spans of improbable runs: maximum-scoring segments over adjacent pairs, in order."""
        height = self.height(points_of("\n" + text + "\n"))
        starts = np.flatnonzero(height == 0)
        tops = np.maximum.reduceat(height, starts)
        ends = np.append(starts[1:], len(height))
        out = []
        for k in np.flatnonzero(tops >= LEAST_RUN):
            a = starts[k]
            top = a + int(np.argmax(height[a : ends[k]]))
            out.append((max(0, int(a) - 1), min(len(text), top)))
        return out

    def marks(self, text: str) -> np.ndarray:
        """``sequence_marks`` of a text, at the places where what may start there gives a character that the corpus uses or
        that may be misread once more."""
        marks = sequence_marks(points_of(text))
        for i in np.flatnonzero(marks):
            if not self.viable(text[i : i + 4], int(marks[i])):
                marks[i] = 0
        return marks

    def viable(self, start: str, bits: int) -> bool:
        """Whether the first sequence of one to three characters more gives a character of use. Answers are kept, 100,000 at most."""
        out = self.starts.get(start)
        if out is None:
            out = False
            for tool, _ in tools_of(bits):
                for fresh in (tool.undo(start[:n]) for n in (2, 3, 4) if set(start[:n]) <= tool.bytes.keys()):
                    out = out or fresh is not None and len(fresh) == 1 and (fresh in AGAIN or bool(self.known[_CLASS[ord(fresh)]]))
            if len(self.starts) >= 100_000:
                self.starts.clear()
            self.starts[start] = out
        return out

    def gains(self, keys: list[str]) -> list[tuple[float, np.ndarray]]:
        """Bits that each word gains by each swap, and the most of them, 0 at least; a key is a word with the characters
        on its two sides. Known keys are kept, 100,000 at most."""
        if len(self.kept) > 100_000:
            self.kept.clear()
        new = []
        for k in dict.fromkeys(keys):
            if k not in self.kept:
                if WIDE.search(k):  # no swap gives such a letter
                    self.kept[k] = (0.0, NOTHING)
                else:
                    new.append(k)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            rows = _word_gains(some, self)
            for k, most, row in zip(some, np.maximum(rows.max(axis=1), 0.0).tolist(), rows):
                self.kept[k] = (most, row)
        return [self.kept[k] for k in keys]


def _stray(text: str, m: re.Match, tool: Misreading) -> int:
    """Characters of the word around a match that would be bytes of the misreading, yet form no sequence."""
    a = max(text.rfind(ch, 0, m.start()) for ch in BLANKS) + 1
    b = min((z for z in (text.find(ch, m.end()) for ch in BLANKS) if z >= 0), default=len(text))
    return sum(ch in tool.bytes for ch in HIGH.findall(tool.pattern.sub("", text[a:b])))


def _inner(fresh: str, model: PairModel) -> list[str]:
    """Readings of decoded text: restored further; or, where that changes nothing, also one layer down, which may gain in its place."""
    if LEADS.isdisjoint(fresh):
        return [fresh]
    again = restore(fresh, model, deep=False)[0]
    if again != fresh:
        return [again]
    return [fresh, *(x for x in (t.undo(fresh) for t in misreadings()[:2] if t.pattern.fullmatch(fresh)) if x is not None)]


def _reading(tool: Misreading, before: str, span: str, after: str, model: PairModel) -> tuple[str, float] | None:
    """What a misread span was, and the bits that it gains between two characters; None if it is no text. Known
    answers on short spans are kept, 100,000 at most."""
    key = (tool, before, span, after)
    if key in model.read:
        return model.read[key]
    out = None
    fresh = tool.undo(span)
    if fresh is not None:
        again = max(_inner(fresh, model), key=lambda x: model.bits(before + x + after))
        single = len(EAST_LETTER.findall(again)) == 1 and not EAST_LETTER.search(before + after)  # one such letter alone is no text
        if not single and not any(0x7F < ord(ch) < 0xA0 for ch in again) and model.known[classes_of(points_of(again))].all():
            out = again, model.bits(before + again + after) - model.bits(before + span + after)
    if len(span) <= 32:
        if len(model.read) >= 100_000:
            model.read.clear()
        model.read[key] = out
    return out


def _undo_utf8(text: str, a: int, b: int, model: PairModel, bits: int) -> tuple[str, float] | None:
    """Best reading of text[a:b] with its misread UTF-8 undone, and the bits it gains."""
    best, gain = None, 0.0
    for tool, extra in tools_of(bits):
        out, at, won = [], a, 0.0
        for m in tool.pattern.finditer(text, a, b):
            read = _reading(tool, text[max(0, m.start() - 1) : m.start()] or "\n", m.group(), text[m.end() : m.end() + 1] or "\n", model)
            if read is None or read[1] <= SEQUENCE_MARGIN + extra:
                continue
            again, more = read
            if more > SEQUENCE_MARGIN + extra + STRAY or not _stray(text, m, tool):
                out += (text[at : m.start()], again)
                at, won = m.end(), won + more - extra
        if won > gain:
            best, gain = "".join([*out, text[at:b]]), won
    return None if best is None else (best, gain)


def _may_be_east(text: str) -> bool:
    """Whether a text has what a first byte of kana is read as, among six characters that are read from high bytes."""
    return bool(EAST_LEADS.search(text)) and any(map(EAST_LEADS.search, DENSE.findall(text)))


def _undo_east(text: str, a: int, b: int, model: PairModel) -> tuple[str, float] | None:
    """A stretch of an East Asian encoding read byte by byte: long enough, with kana, and more probable."""
    best, gain = None, MARGIN
    for read in LATIN_READ:
        table = byte_table(read)
        for m, true in [(m, true) for true in EAST for m in high_runs(read, true).finditer(text, a, b)]:
            raw = bytes(table.get(ch) or ord(ch) for ch in m.group())
            if sum(x > 0x7F for x in raw) > 5:
                for cut in (0, 1):
                    fresh = raw[cut:].decode(true, "replace")
                    if len(fresh) < 4 or fresh.count("\ufffd") * 8 > len(fresh) or len(KANA.findall(fresh)) * 5 < len(fresh):
                        continue
                    won = model.bits("\n" + fresh) - model.bits("\n" + m.group())
                    if won > gain:
                        best, gain = text[a : m.start()] + fresh.strip("\ufffd") + text[m.end() : b], won
    return None if best is None else (best, gain)


@cache
def _wide_lengths(encoding: str) -> np.ndarray:
    """By code point, the number of bytes that it takes; one for those that the encoding lacks, which become "?"."""
    out = np.ones(0x110000, dtype=np.uint8)
    taken = np.concatenate([np.arange(0x80, 0xD800), np.arange(0xE000, 0x10000)])
    out[taken] = list(map(len, "\n".join(map(chr, taken)).encode(encoding, "replace").split(b"\n")))
    return out


def _identity_bits(text: str) -> float:
    kana = len(KANA.findall(text))
    return KANA_BITS * kana + WIDE_BITS * (len(WIDE.findall(text)) - kana)


def _plausible(raw: bytes, model: PairModel) -> bool:
    """Whether bytes are UTF-8 of characters that the corpus uses."""
    out = model.uses.get(raw)
    if out is None:
        try:
            points = points_of(raw.decode("utf-8"))
            out = bool(model.known[classes_of(points)].all()) and not bool(((points > 0x7F) & (points < 0xA0)).any())
        except UnicodeDecodeError:
            out = False
        if len(raw) <= 16:
            if len(model.uses) >= 100_000:
                model.uses.clear()
            model.uses[raw] = out
    return out


def _undo_wide(text: str, model: PairModel) -> tuple[str, int]:
    """The text with UTF-8 read as a two-byte encoding undone where that gains the margin, and the number of stretches."""
    won: list[tuple[float, int, int, str]] = []
    points = points_of(text) if WIDE.search(text) else None
    for encoding in WIDE_READ if points is not None else ():
        raw = text.encode(encoding, "replace")
        hits = [m for m in SEQUENCES.finditer(raw) if _plausible(m.group(), model)]
        if not hits:
            continue
        ends = np.concatenate([[0], np.cumsum(_wide_lengths(encoding)[points], dtype=np.int64)])
        stops = np.array([m.end() for m in hits])
        inside = ends[np.searchsorted(ends, stops)] != stops  # the last byte may be the first of a character whose second is ASCII
        first = np.searchsorted(ends, np.array([m.start() for m in hits]))
        last = np.searchsorted(ends, stops + inside)
        for m, a, b, more in zip(hits, first.tolist(), last.tolist(), inside.tolist()):
            stop = m.end() + more
            if ends[a] != m.start() or ends[b] != stop or (more and raw[m.end()] > 0x7F) or not WIDE.search(text, a, b):
                continue
            fresh = raw[m.start() : stop].decode("utf-8")
            before, after = text[max(0, a - 1) : a] or "\n", text[b : b + 1] or "\n"
            key = (before, text[a:b], after, fresh)
            gain = model.won.get(key)
            if gain is None:
                gain = model.bits(before + fresh + after) - model.bits(before + text[a:b] + after) + _identity_bits(text[a:b]) - _identity_bits(fresh)
                if b - a < 9:
                    if len(model.won) >= 100_000:
                        model.won.clear()
                    model.won[key] = gain
            if gain > MARGIN:
                won.append((gain, a, b, fresh))
    if not won:
        return text, 0
    taken: list[tuple[int, int, str]] = []
    for _, a, b, fresh in sorted(won, reverse=True):
        k = bisect_left(taken, (a, b, fresh))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
            taken.insert(k, (a, b, fresh))
    out, at = [], 0
    for a, b, fresh in taken:
        out += (text[at:a], fresh)
        at = b
    return "".join([*out, text[at:]]), len(taken)


@cache
def _swap_classes() -> tuple[np.ndarray, np.ndarray]:
    """By swap and class: the class it becomes, and whether the misreading can give it. The last row is no swap:
    it reads letters of other scripts as the Latin letters that they look like."""
    to = np.tile(np.arange(SIZE, dtype=np.int32), (len(SWAPS) + 1, 1))
    readable = np.zeros((len(SWAPS) + 1, SIZE), dtype=bool)
    readable[-1] = True
    for group in SHAPES:
        for ch in group[1:] if group[0].isascii() else "":
            to[-1, _CLASS[ord(ch)]] = ord(group[0])
    readable[:, :128] = True
    for k, table in enumerate(swaps()):
        for ch in byte_table(SWAPS[k][0]):
            c = _CLASS[ord(ch)]
            readable[k, c] = True
            if c < OTHER and ord(ch) in table:
                to[k, c] = _CLASS[ord(table[ord(ch)])]
    return to, readable


def _word_gains(keys: list[str], model: PairModel) -> np.ndarray:
    """Bits that each word (row) gains by each swap (column) beyond those of its reading as look-alike letters;
    a word with characters that the misreading cannot give, or that would mix scripts or take letters from a plain word, gains none.

    A key is a word between the characters on its two sides."""
    to, readable = _swap_classes()
    c = classes_of(points_of("".join(keys)))
    ends = np.cumsum(np.fromiter(map(len, keys), dtype=np.int64, count=len(keys)))
    first, last = ends - np.fromiter(map(len, keys), dtype=np.int64, count=len(keys)) + 1, ends - 1
    d = to[:, c]
    at = np.stack([first, last], axis=1).ravel()  # words and what lies between, by turns

    def within(x: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(x, at, axis=1)[:, ::2]

    # a word's pairs begin with the character before it
    bits = np.add.reduceat(model.cond[d[:, :-1], d[:, 1:]] - model.cond[c[:-1], c[1:]], np.minimum(at - 1 + np.arange(len(at)) % 2, len(c) - 2), axis=1)[:, ::2]
    odd, mixed, lost = within(~readable[:, c]), within((d != c) & (d >= 0x370) & (d < 0x530)), within(_LETTER[c] & ~_LETTER[d])
    latin = np.concatenate([[0], np.cumsum(_ASCII_LETTER[c])])
    plain = latin[last] > latin[first]
    natural = np.array([natural_word(k[1:-1].strip(MARKS)) for k in keys], dtype=bool)
    gains = np.where(odd | (mixed & plain) | (natural & lost), -MARGIN, bits)
    return (gains[:-1] - np.maximum(gains[-1], 0.0)).T.astype(np.float32)


def _words(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of the words of text[a:b] that are not ASCII, in order, and their keys. Both ends are at blanks."""
    spans = [m.span() for m in FOREIGN.finditer(text, a, b)]
    return spans, [(text[x - 1] if x else "\n") + text[x : y + 1] + ("" if y < len(text) else "\n") for x, y in spans]


def _to_blanks(text: str, a: int, b: int) -> tuple[int, int]:
    """text[a:b] with the rest of the words at its ends."""
    return max(text.rfind(ch, 0, a) for ch in BLANKS) + 1, min((z for z in (text.find(ch, b) for ch in BLANKS) if z >= 0), default=len(text))


def _undo_swap(text: str, a: int, b: int, model: PairModel) -> tuple[str, float, int] | None:
    """The best single-byte swap of whole words of text[a:b]: its maximum-scoring stretch of words must gain the margin."""
    spans, keys = _words(text, a, b)
    known = model.gains(keys)
    if sum(most for most, _ in known) <= MARGIN:
        return None
    gains = np.array([row for _, row in known]).T
    if np.maximum(gains, 0.0).sum(axis=1).max() <= MARGIN:
        return None
    total = np.hstack([np.zeros((len(gains), 1)), np.cumsum(gains, axis=1, dtype=np.float64)])
    above = total - np.minimum.accumulate(total, axis=1)
    k, end = np.unravel_index(int(np.argmax(above)), above.shape)
    won = float(above[k, end])
    if won <= MARGIN:
        return None
    start = int(np.flatnonzero(above[k, : end + 1] == 0)[-1])
    x, y = spans[start][0], spans[end - 1][1]
    return text[a:x] + text[x:y].translate(swaps()[k]) + text[y:b], won, int(k)


def _spread_swap(text: str, k: int, model: PairModel) -> str:
    """A swap that holds in one place of a text, done to its other words that gain by it."""
    spans, keys = _words(text, 0, len(text))
    out, at = [], 0
    for (x, y), (_, row) in zip(spans, model.gains(keys)):
        won = row[k]
        if won > LEAST_WORD:
            out += (text[at:x], text[x:y].translate(swaps()[k]))
            at = y
    return "".join([*out, text[at:]])


def suspects(texts: list[str], model: PairModel) -> np.ndarray:
    """Which texts may hold something that ``restore`` would find; a test over all texts at once that misses none.

    A run is of use only where a mapping can be tested in it: a misread sequence, first bytes of kana among six
    characters, or words that could gain by a swap. Besides, letters of two-byte encodings whose bytes are UTF-8,
    and what ``evident`` or U+FFFD tells.
    """
    whole = Batch(texts, 2)
    p = whole.points
    height = model.height(p, whole.ends[:-1])
    inside = (p >= 0x80) & (p < 0xA0) & (p != 0x85) | (p == 0xFFFD) | (whole.marks & 3 != 0)
    out = np.logical_or.reduceat(inside, whole.starts - 1)
    starts = np.flatnonzero(height == 0)
    long = np.flatnonzero(np.maximum.reduceat(height, starts) >= LEAST_RUN)
    a = starts[long]
    b = np.append(starts[1:], len(height))[long]
    text = np.searchsorted(whole.starts - 1, a, side="right") - 1
    marked = np.flatnonzero(whole.marks)
    x, y = np.searchsorted(marked, np.maximum(a - 4, whole.starts[text])), np.searchsorted(marked, np.minimum(b + 4, whole.ends[text]))
    for i, low, high in zip(text.tolist(), x.tolist(), y.tolist()):
        if low < high and not out[i]:
            at = whole.starts[i]
            out[i] = any(model.viable(texts[i][m - at : m - at + 4], int(whole.marks[m])) for m in marked[low:high].tolist())
    x, y = np.maximum(a - 4, whole.starts[text]) - whole.starts[text], np.minimum(b + 4, whole.ends[text]) - whole.starts[text]
    open_ = [(i, _words(texts[i], *_to_blanks(texts[i], low, max(low, high)))[1]) for i, low, high in zip(text.tolist(), x.tolist(), y.tolist()) if not out[i]]
    known = iter(model.gains([k for _, keys in open_ for k in keys]))
    for i, keys in open_:
        out[i] |= sum(most for most, _ in islice(known, len(keys))) > MARGIN
    for i in np.unique(text[~out[text]]):
        out[i] = _may_be_east(texts[i])
    for i in np.flatnonzero(~out):
        out[i] = bool(WIDE.search(texts[i])) and any(_plausible(x, model) for e in WIDE_READ for x in SEQUENCES.findall(texts[i].encode(e, "replace")))
    return out


ROUNDS = 6


def restore(text: str, model: PairModel, deep: bool = True, rounds: int = ROUNDS) -> tuple[str, int, bool]:
    """(restored text, runs undone, whether all that was found could be restored).

    A round undoes all runs of a text; further rounds go on from what it gave, as long as one changes something."""
    found = 0
    for _ in range(rounds):
        if text.isascii():
            break
        if deep:
            text, wide = _undo_wide(text, model)
            found += wide
        out, at, changed, swapped = [], 0, 0, set()
        marks = model.marks(text)
        runs = model.runs(text)
        east = deep and _may_be_east(text)
        for a, b in runs:
            a, b = max(at, a - 3), min(len(text), b + 3)
            if b <= a:
                continue
            bits = int(np.bitwise_or.reduce(marks[a:b]))
            undone = _undo_utf8(text, a, b, model, bits) if bits else None
            if deep:
                tried = [x for x in (undone, _undo_east(text, a, b, model) if east else None) if x]
                x, y = _to_blanks(text, a, b)
                x = max(at, x)
                swap = _undo_swap(text, x, y, model)
                undone = max(tried, key=lambda t: t[1], default=None)
                if swap and (undone is None or swap[1] > undone[1]):
                    undone, a, b = swap, x, y
                    swapped.add(swap[2])
            if undone is not None and undone[0] != text[a:b]:
                out += (text[at:a], undone[0])
                at, changed = b, changed + 1
        if not changed:
            break
        found += changed
        text = "".join([*out, text[at:]])
        for k in sorted(swapped):
            text = _spread_swap(text, k, model)
    return text, found, "\ufffd" not in text and not (deep and not found and evident(text))


_models: dict[int, PairModel] = {}


def _model(pairs: bytes, counts: bytes) -> PairModel:
    key = hash((pairs, counts))
    if key not in _models:
        _models.clear()
        _models[key] = PairModel(np.frombuffer(pairs, dtype=np.int64), np.frombuffer(counts, dtype=np.int64))
    return _models[key]


def garbled(df: DataFrame, key: str, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, restored, runs, whole) of every text with a garbled sequence.

    With one round the same texts come out, but those garbled in layers are not restored to the end: for callers that want the keys only.

    ``runs``: stretches undone; ``whole``: nothing is left that cannot be restored. Null, empty and ASCII texts
    are never garbled. The pair counts come from all rows of ``df``; an empty table gives no rows. Beside them
    nothing is shuffled or broadcast, and their size is bounded by SIZE squared.
    """
    table = pair_counts(df, text).toPandas()
    shared = df.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(np.int64).tobytes(), table["n"].to_numpy(np.int64).tobytes()))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike("[^\\x00-\\x7f]"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(*shared.value)
        for batch in batches:
            out, keys, at = [], batch["key"].tolist(), 0
            for texts in _slices(batch["text"]):
                for i in np.flatnonzero(suspects(texts, model)):
                    fresh, runs, whole = restore(texts[i], model, rounds=rounds)
                    if runs or not whole:
                        out.append((keys[at + i], fresh, runs, whole))
                at += len(texts)
            yield pd.DataFrame(out, columns=["key", "restored", "runs", "whole"])

    return rows.mapInPandas(run, f"key {kind}, restored string, runs int, whole boolean").withColumnRenamed("key", key)

"""Visually identical text in different characters: one form for all spellings that look the same.

Look-alike relations over code points and strings come from rules (compatibility decompositions of width,
font and ligatures; spaces; hyphens; invisible characters) and from one short table of letters of other
scripts. Two levels are kept:

* Coarse classes: the transitive closure, by union-find, of shape and of letter case over the code points
  that occur. Each class is represented by its most frequent member. A text's key is its rewriting, greedily
  leftmost-longest, by an automaton over all members that are not representatives. Texts that look the same
  have the same key; as closure runs over case (N, Greek Nu, its small form, v) a few others do as well.
* Fine forms: per word, capitals are read as letters of a script that the word is written in before they are
  made small. They decide, for the few pairs that share a key, whether two texts look the same.

The alphabet that occurs is bounded by Unicode, whatever the corpus; it alone reaches the driver.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.runtime import materialize, skew_join

# Letters of the same shape and case, Latin first.
SHAPES = (
    "aа", "cсϲ", "eе", "iі", "jјϳ", "oоοօ", "pрρ", "sѕ", "xх", "yу", "hһհ", "dԁ", "qԛ", "wԝ", "vνѵ", "lӏ", "uս", "gɡ",
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜ", "NΝ", "OОΟՕ", "PРΡ", "SЅ", "TТΤ", "XХΧ", "YΥҮ", "ZΖ", "QԚ", "WԜ", "ГΓ", "ПΠ", "ФΦ", "σς",
)
# Characters without width or ink beside those of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")


def script(ch: str) -> str:
    """Script of a letter by its Unicode name; empty for other scripts and characters."""
    name = unicodedata.name(ch, "")
    return next((s for s in SCRIPTS if name.startswith(s)), "")


def plain_parts(ch: str) -> str:
    """What a code point stands for when displayed: '' if invisible, ' ' for spaces, '-' for hyphens, the base
    letters of full or half width, font and ligature forms; else itself."""
    kind = unicodedata.category(ch)
    if ch in INVISIBLE or kind == "Cf":
        return ""
    if kind == "Zs" or ch in "\t\n\r\v\f\x85  ":
        return " "
    if kind == "Pd" or ch == "−":
        return "-"
    tag, _, points = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>", "<font>") or tag == "<compat>" and kind[0] in "LN":
        text = "".join(chr(int(p, 16)) for p in points.split())
        return unicodedata.normalize("NFD", "".join(map(plain_parts, text)))
    return ch


class Union:
    """Union-find with path halving over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: str, y: str) -> None:
        self.up[self.find(x)] = self.find(y)


class LookAlikes:
    """Classes, representatives, automaton and comparison for an alphabet with frequencies."""

    def __init__(self, counts: dict[str, int]):
        self.fine: dict[str, str] = {}
        self.variants: dict[str, dict[str, str]] = {}
        for group in SHAPES:
            for ch in group:
                self.fine[ch] = group[0]
                self.variants[ch] = {script(x): x for x in reversed(group)}
        alphabet = set(counts) | {x for ch in counts for x in unicodedata.normalize("NFD", ch)} | {ch for g in SHAPES for ch in g}
        seen: dict[str, int] = dict.fromkeys(alphabet, 0)
        for ch, n in counts.items():
            for x in unicodedata.normalize("NFD", ch):
                seen[x] = seen.get(x, 0) + n
        classes = Union()
        for ch in sorted(alphabet):
            parts = plain_parts(ch)
            classes.join(ch, parts)
            for x in {ch, *parts}:
                for cased in (x.lower(), x.upper()):
                    if len(cased) == 1:
                        classes.join(x, cased)
        for group in SHAPES:
            for ch in group:
                classes.join(ch, group[0])
        members: dict[str, list[str]] = {}
        for x in list(classes.up):
            members.setdefault(classes.find(x), []).append(x)
        one: dict[str, str] = {}
        for group in members.values():
            fixed = [x for x in group if x in ("", " ", "-")]
            single = [x for x in group if len(x) == 1]
            best = fixed[0] if fixed else min(single, key=lambda x: (-seen.get(x, 0), x)) if single else ""
            for x in group:
                if len(x) == 1:
                    one[x] = best
        self.rewrite_to: dict[str, str] = {}
        for ch in one:
            parts = plain_parts(ch)
            to = "".join(one.get(p, p) for p in parts) if len(parts) > 1 else one[ch]
            if to != ch:
                self.rewrite_to[ch] = to
        self.automaton = ahocorasick.Automaton()
        for ch, to in self.rewrite_to.items():
            self.automaton.add_word(ch, (len(ch), to))
        self.automaton.make_automaton()

    def key(self, text: str) -> str:
        """Coarse key: greedy leftmost-longest rewriting to representatives; spelling of spaces aside."""
        text = unicodedata.normalize("NFD", text)
        if self.rewrite_to:
            out, at = [], 0
            for end, (size, to) in self.automaton.iter_long(text):
                out += (text[at : end - size + 1], to)
                at = end + 1
            text = "".join([*out, text[at:]])
        return " ".join(unicodedata.normalize("NFD", text).split())

    def shown(self, text: str) -> list[str]:
        """Words of the text as displayed: decomposed, without width, font, ligature, invisible and space kinds."""
        plain = "".join(map(plain_parts, unicodedata.normalize("NFD", text)))
        return unicodedata.normalize("NFD", plain).split()

    def readings(self, word: str) -> set[str]:
        """Small forms of a word of ``shown``, one for each script in which its capitals can be read."""
        letters = [ch for ch in word if ch.isalpha()]
        scripts = {script(ch) for ch in letters} - {""}
        if all(script(ch) == "LATIN" or "LATIN" in self.variants.get(ch, ()) for ch in letters):
            scripts.add("LATIN")
        out = set()
        for s in scripts or {""}:
            low = "".join(self.variants.get(ch, {}).get(s, ch).lower() if ch.isupper() else ch for ch in word)
            out.add("".join(self.fine.get(ch, ch) for ch in low.lower()))
        return out

    def form(self, text: str) -> str:
        """One form of a text: of each word the reading in the script with most letters of its own, else Latin."""
        out = []
        for word in self.shown(text):
            own = [script(ch) for ch in word if ch.isalpha() and len(self.variants.get(ch, ())) < 2 and script(ch)]
            s = max(sorted(set(own)), key=own.count) if own else "LATIN"
            low = "".join(self.variants.get(ch, {}).get(s, ch).lower() if ch.isupper() else ch for ch in word)
            out.append("".join(self.fine.get(ch, ch) for ch in low.lower()))
        return " ".join(out)

    def same(self, x: str, y: str) -> bool:
        """Whether two texts look the same when displayed, letter case aside."""
        a, b = self.shown(x), self.shown(y)
        return len(a) == len(b) and all(p == q or not self.readings(p).isdisjoint(self.readings(q)) for p, q in zip(a, b))


_built: dict[int, LookAlikes] = {}


def _look_alikes(counts: dict[str, int]) -> LookAlikes:
    key = hash(frozenset(counts.items()))
    if key not in _built:
        _built.clear()
        _built[key] = LookAlikes(counts)
    return _built[key]


def code_point_counts(texts: DataFrame, text: str, weight: str) -> dict[str, int]:
    """How often each code point occurs; at most one entry a code point of Unicode, so bounded for any corpus."""
    rows = (
        texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0))).alias("ch"), F.col(weight).alias("w"))
        .groupBy("ch")
        .agg(F.sum("w").alias("n"))
        .collect()
    )
    return {r["ch"]: r["n"] for r in rows if r["ch"]}


def with_keys(texts: DataFrame, text: str, counts: dict[str, int]) -> DataFrame:
    """Adds ``look_key`` (coarse key) and ``look_form`` (fine form); null text gives null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = _look_alikes(counts)
        for batch in batches:
            batch["look_key"] = [None if x is None else look.key(x) for x in batch[text]]
            batch["look_form"] = [None if x is None else look.form(x) for x in batch[text]]
            yield batch

    return texts.mapInPandas(run, schema + ", look_key string, look_form string")


def same_look(x: str, y: str, counts: dict[str, int]):
    """Column: whether two text columns look the same."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        look = _look_alikes(counts)
        return pd.Series([p is not None and q is not None and look.same(p, q) for p, q in zip(a, b)], dtype=bool)

    return run(F.col(x), F.col(y))


def surface_matches(mentions: DataFrame, concepts: DataFrame, surface: str = "surface", concept: str = "id", label: str = "label") -> DataFrame:
    """(surface, n, concept_id, label): distinct surfaces with each concept whose label looks the same.

    ``n``: rows of ``mentions`` with the surface. Null and empty surfaces and labels take no part. Surfaces
    are reduced to distinct ones, counted map-side, before any text leaves the JVM.
    """
    surfaces = materialize(mentions.select(F.col(surface).alias("surface")).filter("surface <> ''").groupBy("surface").agg(F.count("*").alias("n")))
    labels = materialize(concepts.select(F.col(concept).alias("concept_id"), F.col(label).alias("label")).filter("label <> ''").distinct())
    counts = code_point_counts(surfaces.unionByName(labels.select(F.col("label").alias("surface"), F.lit(1).cast("long").alias("n"))), "surface", "n")
    a = with_keys(surfaces, "surface", counts).drop("look_form")
    b = with_keys(labels, "label", counts).drop("look_form")
    pairs = a.join(b, "look_key").drop("look_key")
    return pairs.filter(same_look("surface", "label", counts))


def disguised_mentions(mentions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(mention_id, concept_id): mentions whose surface looks like a label but is not the label in small letters."""
    matches = materialize(surface_matches(mentions, concepts).filter("lower(surface) <> label"))
    rows = mentions.select("mention_id", "surface")
    return skew_join(rows, matches.select("surface", "n", "concept_id"), "surface", "n").select("mention_id", "concept_id").distinct()


def unified_forms(mentions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(text, kind, form, n): the form of every distinct surface and label."""
    surfaces = mentions.select(F.col("surface").alias("text"), F.lit("surface").alias("kind"))
    labels = concepts.select("id", F.col("label").alias("text"), F.lit("label").alias("kind")).distinct().drop("id")
    texts = materialize(surfaces.unionByName(labels).filter("text <> ''").groupBy("text", "kind").agg(F.count("*").alias("n")))
    counts = code_point_counts(texts, "text", "n")
    return with_keys(texts, "text", counts).select("text", "kind", F.col("look_form").alias("form"), "n")

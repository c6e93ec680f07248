"""Abusive, hateful and sexually explicit language: a weighted finite-state pattern grammar.

Transducers are composed as a cascade. The first maps a token, in whatever spelling, to classes of
words, each with a strength. The second brackets phrases - insults, targets, groups, vermin, parts of
a body, acts of harm - and hands on their symbol and weight. The third matches clauses over phrases:
an insult with its target, a threat with its victim, a wish of harm, a group degraded or to be driven
out, a sexual offer or demand. A clause weighs its rule's base plus what its parts weigh; the last
machines read negation, reported speech and offices before and inside a match and take a share away.
Words alone score nothing. Only sentences with a word that can carry a clause go through the cascade.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.grammar import STOP, Machine, Pattern
from tidewell.llm.lexicon import ANCHORS, CLAUSES, LEXICON, PARTNERS, PHRASES, STRENGTH, STRONG, WORD_STRENGTH
from tidewell.llm.text import INVISIBLE, LINE_HYPHEN, cleaned

#: A document is flagged if one of its clauses weighs this much.
THRESHOLD = 1.0
CATEGORIES = ("abusive", "hateful", "sexual")
#: What context leaves of a clause's weight.
NEGATED, REPORTED, OFFICIAL = 0.3, 0.4, 0.8

# Letters of other scripts that look like Latin ones; digits and signs for letters.
ALIKE = dict(zip("аеорсухікмтвнѕјԁɡӏгαοειкνρτυκ", "aeopcyxikmtbhsjdglraoeiknptuk", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
WILD = "*#@%$?"
TOKEN = re.compile(r"[^\W_](?:[\w*#@$%€!|'’.]*[\w*$@#])?|[*#@$%][\w*#@$%]*\w|[.!?]+(?=\s|$)|\n\s*\n")
ENDING = ("s", "es", "en", "e", "n", "er")
PRE_LEAK = "ÃÂ"


def _without_accents(s: str) -> str:
    return s if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _squeeze(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", w)


#: Endings of invented or real names of peoples, where no list knows the word.
PEOPLES = re.compile(r"^(?:[A-Z][a-z]{2,}|[A-Z]{4,}|[a-z]{4,})(?<!ss)(?:ese|rri|nis|ians|anis|ites|ITES|ESE|RRI|NIS|IANS)$")
#: Ordinary words that look like such names.
NO_PEOPLES = set("cheese these geese obese diocese tennis penis basis sherri favorites websites suites sites bites kites invites writes unites ignites excites politicians musicians physicians technicians electricians civilians guardians librarians historians comedians magicians pedestrians veterinarians custodians".split())


class Symbols(frozenset):
    """The classes of a token, its strength per class, and whether it can carry a clause."""

    strength: dict[str, float]
    anchor: bool


def symbols(classes: set[str], strength: dict[str, float]) -> Symbols:
    s = Symbols(classes)
    s.strength, s.anchor = strength, bool(classes & ANCHORS)
    return s


PLAIN, END = symbols(set(), {}), symbols({STOP}, {})


class Words(dict):
    """First machine: a token in any spelling → its classes, and itself if a rule names it."""

    def __init__(self, literals: frozenset[str]) -> None:
        super().__init__()
        self.classes: dict[str, set[str]] = {}
        for name, text in LEXICON.items():
            for w in text.split():
                self.classes.setdefault(w, set()).add(name)
        self.literals = literals
        self.by_length: dict[int, list[str]] = {}
        for w in {*self.classes, *literals}:
            self.by_length.setdefault(len(w), []).append(w)
        # doubled letters are undone only towards words that no ordinary word resembles
        self.squeezed: dict[str, str] = {}
        for w, names in self.classes.items():
            if len(w) >= 4 and names & {"INSULT", "FOUL", "VERMIN", "SLUT", "PORN", "SEXVERB", "HOT", "NUDE", "HORNY"}:
                self.squeezed.setdefault(_squeeze(w), w)

    def __missing__(self, token: str) -> Symbols:
        if len(self) > 300_000:
            self.clear()  # bounds memory only
        got = self[token] = self._symbols(token)
        return got

    def _symbols(self, token: str) -> Symbols:
        if token[0] in ".!?\n":
            return END
        out: set[str] = set()
        strength: dict[str, float] = {}
        for w in self.spellings(token):
            if w in self.literals:
                out.add(w)
            found, known = self.classes.get(w), w
            if found is None and len(w) >= 5:
                for e in ENDING:
                    if w.endswith(e) and (f := self.classes.get(w[: -len(e)])) and f & OPEN:
                        found, known = f & OPEN, w[: -len(e)]
                        break
            if found is None and w not in self.literals and len(w) >= 5 and (near := self.squeezed.get(_squeeze(w))):
                found, known = self.classes[near], near
            for c in found or ():
                out.add(c)
                strength[c] = max(strength.get(c, 0.0), WORD_STRENGTH.get((c, known), STRENGTH.get(c, 0.0)))
        if not out and PEOPLES.match(token) and token.lower() not in NO_PEOPLES:
            out.add("DEMONYM")
            strength["DEMONYM"] = STRENGTH["DEMONYM"]
        elif not out and len(token) > 3 and token[0].isupper() and token.isalpha():
            out.add("NAME")
            strength["NAME"] = STRENGTH["NAME"]
        return symbols(out, strength) if out else PLAIN

    def spellings(self, token: str) -> list[str]:
        """The word itself and what it may stand for: look-alike letters, digits and signs for
        letters, masked letters, stretched letters."""
        t = token.lower().replace("’", "'").strip("'")
        t = "".join(ALIKE.get(c, c) for c in t) if not t.isascii() else t
        t = _without_accents(t)
        out = [t]
        if "'" in t:
            out += [t.split("'")[0], t.split("'")[-1], t.replace("'", "")]
        if "." in t and all(len(x) <= 1 for x in t.split(".")):
            out.append(t.replace(".", ""))
        if not t.isalpha():
            letters = sum(c.isalpha() for c in t)
            if letters:
                plain = "".join(LEET.get(c, c) for c in t)
                out += [plain, "".join("l" if c == "1" else LEET.get(c, c) for c in t)]
            if letters >= 2 and any(c in WILD for c in t) and len(t) >= 4:
                p = re.compile("".join("." if c in WILD else re.escape(LEET.get(c, c)) for c in t) + "$")
                out += [w for w in self.by_length.get(len(t), ()) if p.match(w)]
        if re.search(r"(.)\1\1", t):
            out += [re.sub(r"(.)\1{2,}", r"\1", t), re.sub(r"(.)\1{2,}", r"\1\1", t)]
        return out


OPEN = {"INSULT", "VERMIN", "PEOPLE", "SLUT", "FOUL"}
LEVELS = [Machine([Pattern(name, 0.0, p) for name, p in level]) for level in PHRASES]
RULES = [Pattern(*r) for r in CLAUSES]
CLAUSE = Machine(RULES)
#: What stands right before a match: (name, pattern, share left, categories, needs). "quote" needs an open
#: quotation or a colon before the match; "verb" no punctuation in between and a match that does not
#: begin with its own subject.
CONTEXT = [
    ("reported", "REPORTED at|to|an|a|tegen|zu? ME|THEY|him|her|DET? that|dass|que|dat? DET?", REPORTED, ("abusive", "hateful"), "other"),
    ("reported", "REPORTED _{0,6}", REPORTED, ("abusive", "hateful"), "quote"),
    ("office", "OFFICE _{0,8}", OFFICIAL, ("abusive", "hateful"), "quote"),
    ("negated", "NOT DET? _{0,1}", NEGATED, ("sexual",), ""),
    ("negated", "NOT DET? _{0,1}", NEGATED, ("abusive", "hateful"), "verb"),
    ("negated", "NOT WANT to? _{0,2}", NEGATED, ("sexual",), ""),
    ("negated", "NOT THINK that|dass|que|dat?", NEGATED, ("abusive", "hateful", "sexual"), ""),
]
BEFORE = Machine([Pattern(n, w, p) for n, p, w, *_ in CONTEXT])
#: Rules that name a negator themselves, as "nobody would miss you".
DENYING = [bool(set(re.split(r"[ |?*]", p.text)) & {"NOT", "NONE", *LEXICON["NOT"].split(), "dont"}) for p in RULES]
WORDS = Words(frozenset(s for m in (*LEVELS, CLAUSE, BEFORE) for s in m.alphabet if s == s.lower() and s not in "_."))
#: A match that begins with one of these has a subject of its own, which a negation before it misses.
SUBJECT = {"YOU", "ME", "THEY", "GROUP"}
#: Words of NOT that are something else too, or that ask instead of denying.
NOT_ALSO = {"BODY", "PEOPLE", "KILL"}
ASKING = {"why", "warum", "waarom", "porque", "que"}


def readable(text: str) -> str:
    """Markup resolved, wrong encoding undone where it shows, spaced-out letters joined."""
    for mark in ("<wbr>", "<wbr/>", "&shy;", "&#173;", "&#8203;", "&zwj;", "&zwnj;"):
        if mark in text:
            text = text.replace(mark, "")
    text = cleaned(text)
    if any(c in text for c in PRE_LEAK):
        text = re.sub("[À-ÿ][-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]+", _recode, text)
    text = unicodedata.normalize("NFKC", text) if not text.isascii() else text
    return re.sub(r"(?<![^\W_])[^\W\d_]([ .\-_])(?:[^\W\d_]\1)+[^\W\d_](?![^\W_])", _joined, text)


def _joined(m: re.Match) -> str:
    """Spaced-out letters as one word; a letter at either end may be a word of its own."""
    s = m.group().replace(m.group(1), "")
    for a, b in ((0, len(s)), (1, len(s)), (0, len(s) - 1), (1, len(s) - 1)):
        if b - a > 2 and _without_accents(s[a:b].lower()) in WORDS.classes:
            return f"{s[:a]} {s[a:b]} {s[b:]}"
    return s


def _recode(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group().encode(code).decode("utf-8")
        except UnicodeError:
            pass
    return m.group()


def _open_quote(gap: str) -> bool:
    """Whether a text leaves a quotation open or ends with a colon."""
    opened, closed = max(map(gap.rfind, "“„«")), max(map(gap.rfind, "”»"))
    return gap.count('"') % 2 == 1 or opened > closed or gap.rstrip(" \"'‘“„«").endswith(":")


class Item:
    """A token or phrase of a sentence: its symbols, its first and last token, and its weight by symbol."""

    __slots__ = ("begin", "end", "symbols", "weight")

    def __init__(self, symbols: frozenset[str], begin: int, end: int, weight: dict[str, float]) -> None:
        self.symbols, self.begin, self.end, self.weight = symbols, begin, end, weight


def _bracketed(items: list[Item], level: Machine) -> list[Item]:
    """The leftmost longest phrases of a level as single items; a phrase weighs the strongest reading
    of each of its tokens that its pattern may have meant, foul words adding a fifth each."""
    seq = [x.symbols for x in items]
    best: dict[int, tuple[int, int]] = {}
    for k, end in level.run(seq):
        b = level.begin(k, seq, end, longest=True)
        if b not in best or end > best[b][0]:
            best[b] = (end, k)
    out, at = [], 0
    while at < len(items):
        if at in best:
            end, k = best[at]
            p = level.patterns[k]
            named = frozenset(p.text.replace("|", " ").replace("?", "").replace("*", "").split())
            parts = [[w for s, w in x.weight.items() if s in named] for x in items[at : end + 1]]
            foul = sum(0.2 for x in items[at : end + 1] if "FOUL" in x.symbols and "FOUL" in named and "INSULT" not in x.symbols)
            weight = max((max(w) for w in parts if w), default=0.0) if p.category in ("INS", "VOC", "FOULP", "VERM", "SEXP") else sum(max(w) for w in parts if w)
            if p.category in ("INS", "VOC"):
                weight += foul
            names = {"INS", "VOC"} if p.category == "VOC" else {p.category}
            out.append(Item(frozenset(names), items[at].begin, items[end].end, dict.fromkeys(names, weight)))
            at = end + 1
        else:
            out.append(items[at])
            at += 1
    return out


def _share(k: int, t: str, spans: list[tuple[int, int]], tokens: list[Symbols], first: int, begin: int, end: int) -> float:
    """What negation in, before and after a match and reported speech before it leave of its weight."""
    p, share = RULES[k], 1.0
    if not DENYING[k] and any("NOT" in x and not x & NOT_ALSO for x in tokens[begin : end + 1]):
        share = NEGATED
    if end + 1 < len(tokens) and t[slice(*spans[end + 1])].lower() in ("nicht", "niet"):
        share = NEGATED
    before = tokens[first:begin]
    for c, at in BEFORE.run(before):
        name, _, left, categories, needs = CONTEXT[c]
        if at != len(before) - 1 or p.category not in categories or left >= share:
            continue
        if name == "reported" and "ME" in tokens[first]:
            continue
        start = first + BEFORE.begin(c, before, at)
        gap = t[spans[start][1] : spans[begin][0]]
        if needs == "quote" and not _open_quote(gap):
            continue
        if needs == "other" and start > first and "YOU" in tokens[start - 1]:
            continue
        if needs == "verb":
            asked = start > first and t[slice(*spans[start - 1])].lower() in ASKING
            if asked or tokens[begin] & SUBJECT or re.search(r'[,;:()"“”„«»–—]', gap):
                continue
        share = left
    return share


def _clauses(t: str, spans: list[tuple[int, int]], tokens: list[Symbols], first: int, last: int, group: bool) -> tuple[list[tuple[str, float, int, int]], bool]:
    """(category, weight, first and last token) of the clauses of one sentence, and whether it names a
    group. With ``group`` a pronoun takes up the group of the sentence before."""
    items = [Item(tokens[i], i, i, tokens[i].strength) for i in range(first, last)]
    if group:
        for x in items:
            if "THEY" in x.symbols:
                x.symbols, x.weight = x.symbols | {"GROUP"}, {**x.weight, "GROUP": STRENGTH["PEOPLE"]}
    for level in LEVELS:
        items = _bracketed(items, level)
    named = any("GROUP" in x.symbols for x in items)
    if group or named:
        known = group
        for x in items:
            if known and "THEY" in x.symbols:
                x.symbols = x.symbols | {"GROUP"}
            known = known or "GROUP" in x.symbols
    seq = [x.symbols for x in items] + [frozenset(["END"])]
    out = []
    for k, end in CLAUSE.run(seq):
        p = RULES[k]
        begin = CLAUSE.begin(k, seq, end)
        part = items[begin : end + 1]
        if not part:
            continue
        weight = p.weight
        for x in part:
            got = [w for s, w in x.weight.items() if s in CLAUSE_SYMBOLS[k]]
            weight += max(got, default=0.0)
        weight = min(weight, 2.0) * _share(k, t, spans, tokens, first, part[0].begin, part[-1].end)
        out.append((p.category, round(weight, 4), part[0].begin, part[-1].end))
    return out, named


CLAUSE_SYMBOLS = [frozenset(re.split(r"[ |?*]|\{\d,\d\}", p.text)) for p in RULES]


def judge(text: str) -> tuple[dict[str, float], str]:
    """Weight of the strongest clause per category, and that clause."""
    best = dict.fromkeys(CATEGORIES, 0.0)
    t = readable(text)
    tokens = [WORDS[x] for x in TOKEN.findall(t)]
    carry = [i for i, s in enumerate(tokens) if s.anchor]
    if not carry:
        return best, ""
    spans = [m.span() for m in TOKEN.finditer(t)]
    stops = [-1, *(i for i, s in enumerate(tokens) if STOP in s), len(tokens)]
    clause, at, group, previous = "", 0, False, -2
    for k, (a, b) in enumerate(zip(stops, stops[1:], strict=False)):
        while at < len(carry) and carry[at] <= a:
            at += 1
        if at == len(carry):
            break
        if carry[at] >= b or b - a < 2:
            continue
        here = frozenset().union(*tokens[a + 1 : b])
        if not (here & STRONG or here & PARTNERS):
            continue
        if k and previous != k - 1 and (tokens[a + 1] & {"THEY"}):  # the sentence before was not read
            group = _clauses(t, spans, tokens, stops[k - 1] + 1, a, False)[1]
        elif previous != k - 1:
            group = False
        found, group = _clauses(t, spans, tokens, a + 1, b, group)
        previous = k
        for category, weight, begin, end in found:
            if weight > best[category]:
                if weight > max(best.values()):
                    clause = t[spans[begin][0] : spans[end][1]]
                best[category] = weight
    return best, clause


SCHEMA_DDL = "score double, abusive double, hateful double, sexual double, flagged boolean, clause string"


def scored(docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document: ``score`` (weight of its strongest clause), the weight per category, ``flagged``
    (score at or above THRESHOLD) and that ``clause``; with the columns ``keep``.

    Whole texts are read. Null and empty texts score 0. Rows are scored one by one, so repeated ids
    give repeated rows. A kept column named like one of the result's is called ``<name>_given``.
    """
    own = {"score", *CATEGORIES, "flagged", "clause"}
    names = {c: f"{c}_given" if c in own else c for c in [doc, *(keep or [])]}
    rows = docs.select(F.col(text).cast("string").alias("__text"), *[F.col(c).alias(n) for c, n in names.items()])
    names = list(names.values())
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(t) if t else (dict.fromkeys(CATEGORIES, 0.0), "") for t in b.column(0).to_pylist()]
            cats = [pa.array([g[0][c] for g in got], pa.float64()) for c in CATEGORIES]
            score = [max(g[0].values()) for g in got]
            cols = [*b.columns[1:], pa.array(score, pa.float64()), *cats, pa.array([s >= THRESHOLD for s in score]), pa.array([g[1] or None for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "score", *CATEGORIES, "flagged", "clause"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {types[n]}" for n in names) + ", " + SCHEMA_DDL)


def rates(scores: DataFrame, source: str = "source") -> DataFrame:
    """Per source (null is one of its own): documents, flagged ones and their rate, and the rate per
    category. Aggregated on the map side, so a source with most documents is no burden."""
    high = [F.avg((F.col(c) >= THRESHOLD).cast("double")).alias(f"{c}_rate") for c in CATEGORIES]
    return scores.groupBy(source).agg(F.count("*").alias("documents"), F.sum(F.col("flagged").cast("long")).alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), *high)

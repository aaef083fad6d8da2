"""Full text: stemmed lexemes with positions, web-style queries, and ranks by cover density.

Built-in functions have no stemmer, so texts pass through one Arrow function, at the write of a store that keeps
their lexemes (``text_vector``) or else at the search; lexemes of words are remembered in the worker, so stemming
is paid once a word and not once a place.
The stemmers follow the published Snowball descriptions of English (Porter2) and French.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of title and body, and the words that no index holds.
TITLE, BODY = 1.0, 0.4
ENGLISH_STOP = frozenset("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())
FRENCH_STOP = frozenset("au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y étée étées étant suis es êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fussions fussiez fussent ayant eu eue eues eus ai avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait aviez avaient aie aies ait ayons ayez aient eut eûmes eûtes eurent eusse eusses eût eussions eussiez eussent".split())
_WORD = re.compile(r"[^\W_]+")


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


# --- English ---------------------------------------------------------------------------------------

_EN = "aeiouy"
#: Words with stems of their own, suffixes of steps two to four and what replaces them.
_EN_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_EN_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_TWO = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_EN_THREE = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_FOUR = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _short_end(w: str) -> bool:
    """Ends in a short syllable: vowel and non-vowel at the start, or non-vowel, vowel, non-vowel other than w, x, Y."""
    if len(w) == 2:
        return w[0] in _EN and w[1] not in _EN
    return len(w) > 2 and w[-1] not in _EN + "wxY" and w[-2] in _EN and w[-3] not in _EN


def english_stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word in _EN_WHOLE:
        return _EN_WHOLE[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, _EN)
    r2 = _region(w, _EN, r1)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _EN for c in w[:-2]):
        w = w[:-1]
    if w in _EN_LATER:
        return w
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s and s.startswith("eed"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in _EN for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN:
        w = w[:-1] + "i"
    s = _longest(w, _EN_TWO)
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w[-4] == "l") and (s != "li" or w[-3] in "cdeghkmnrt"):
        w = w[: -len(s)] + _EN_TWO[s]
    s = _longest(w, _EN_THREE)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + _EN_THREE[s]
    s = _longest(w, _EN_FOUR)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4] in "st"):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# --- French ----------------------------------------------------------------------------------------

_FR = "aeiouyâàëéêèïîôûù"
#: Endings of nouns and adjectives, and of verbs in -ir and the others.
_FR_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_FR_NOUNS = _FR_PLAIN + "atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()
_FR_IR = "îmes ît îtes i ie Ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_ER = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _noun(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """The word after the first step, and whether verb endings are still to be tried."""
    s = _longest(w, _FR_NOUNS)
    if not s:
        return w, True
    stem = w[: -len(s)]
    n = len(stem)

    def drop(base: str, *ends: tuple[str, int, str | None]) -> str:
        """Without the first of the endings it has, where its region allows, else with its replacement."""
        for end, region, other in ends:
            if base.endswith(end):
                cut = base[: -len(end)]
                return cut if len(cut) >= region else base if other is None else cut + other
        return base

    if s in ("amment", "emment"):
        return (stem + s[0] + "nt", True) if n >= rv else (w, True)
    if s in ("ment", "ments"):
        return (stem, True) if n > rv and stem[-1] in _FR else (w, True)
    if s == "eaux":
        return stem + "eau", False
    if s == "aux":
        return (stem + "al", False) if n >= r1 else (w, True)
    if s in ("euse", "euses"):
        return (stem, False) if n >= r2 else (stem + "eux", False) if n >= r1 else (w, True)
    if s in ("issement", "issements"):
        return (stem, False) if n >= r1 and stem[-1] not in _FR else (w, True)
    if s in ("ement", "ements"):
        if n < rv:
            return w, True
        if stem.endswith("iv"):
            cut = drop(stem, ("iv", r2, None))
            return (drop(cut, ("at", r2, None)) if cut != stem else cut), False
        if stem.endswith("eus"):
            k = n - 3
            return (stem[:-3] if k >= r2 else stem[:-1] + "x" if k >= r1 else stem), False
        if stem.endswith(("ièr", "Ièr")):
            return (stem[:-3] + "i" if n - 3 >= rv else stem), False
        return drop(stem, ("abl", r2, None), ("iqU", r2, None)), False
    if n < r2:
        return w, True
    if s in _FR_PLAIN:
        return stem, False
    if s.startswith("logi"):
        return stem + "log", False
    if s.startswith(("usion", "ution")):
        return stem + "u", False
    if s.startswith("ence"):
        return stem + "ent", False
    if s.startswith("at"):
        return drop(stem, ("ic", r2, "iqU")), False
    if s.startswith("ité"):
        return drop(stem, ("abil", r2, "abl"), ("ic", r2, "iqU"), ("iv", r2, None)), False
    cut = drop(stem, ("at", r2, None))
    return (drop(cut, ("ic", r2, "iqU")) if cut != stem else cut), False


def _verb(w: str, rv: int, r2: int) -> str:
    tail = w[rv:]
    s = _longest(tail, _FR_IR)
    if s and len(tail) > len(s) and tail[-len(s) - 1] not in _FR:
        return w[: -len(s)]
    s = _longest(tail, [*_FR_ER, *_FR_A, "ions"])
    if not s or (s == "ions" and len(w) - 4 < r2):
        return w
    w = w[: -len(s)]
    return w[:-1] if s in _FR_A and len(w) > rv and w.endswith("e") else w


def french_stem(word: str) -> str:
    w = word.replace("ë", "He").replace("ï", "Hi")
    w = re.sub(rf"(?<=[{_FR}])([ui])(?=[{_FR}])", lambda m: m[1].upper(), w)
    w = re.sub(rf"(?<=[{_FR}])y|y(?=[{_FR}])", "Y", w).replace("qu", "qU")
    if w[:3] in ("par", "col", "tap") or (len(w) > 2 and w[0] in _FR and w[1] in _FR):
        rv = min(3, len(w))
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in _FR), len(w))
    r1 = _region(w, _FR)
    r2 = _region(w, _FR, r1)
    first, verbs = _noun(w, rv, r1, r2)
    last = _verb(first, rv, r2) if verbs else first
    if last != w:
        w = last[:-1] + {"Y": "i", "ç": "c"}.get(last[-1:], last[-1:])
    else:
        if len(w) > 1 and w[-1] == "s" and w[-2] not in "aiouès":
            w = w[:-1]
        s = _longest(w[rv:], ("ion", "ier", "ière", "Ier", "Ière", "e"))
        if s == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and w[rv:-3].endswith(("s", "t")) else w
        elif s:
            w = w[: -len(s)] + ("" if s == "e" else "i")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(rf"[éè]([^{_FR}]+)$", r"e\1", w)
    return w.replace("He", "ë").replace("Hi", "ï").replace("H", "").lower()


# --- lexemes and queries ---------------------------------------------------------------------------


@functools.lru_cache(200_000)
def lexeme(word: str, french: bool) -> str | None:
    """The stem of a lower-case word, None for stop words; numbers stay as they are."""
    if word in (FRENCH_STOP if french else ENGLISH_STOP):
        return None
    return word if word.isdigit() else french_stem(word) if french else english_stem(word)


def vector(text: str | None, french: bool, after: int = 0) -> tuple[list[tuple[str, int]], int]:
    """(lexeme, position) pairs of a text, and the last position; stop words hold a position but are left out."""
    out, at = [], after
    for word in _WORD.findall((text or "").lower()):
        at += 1
        if x := lexeme(word, french):
            out.append((x, at))
    return out, at


@dataclass(frozen=True)
class Term:
    """A word, or a phrase as lexemes with their distances from the first."""

    lexemes: tuple[tuple[str, int], ...]
    negated: bool = False


def web_query(text: str | None, french: bool = False) -> tuple[tuple[Term, ...], ...]:
    """Alternatives of joint terms: words are joined, ``or`` parts them, quotes make phrases, ``-`` negates.

    Terms of stop words only vanish, and alternatives without terms with them; () matches nothing.
    """
    branches: list[list[Term]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', (text or "").lower()):
        if word == "or" and not minus:
            branches.append([])
            continue
        found, _ = vector(phrase or word, french)
        if found:
            branches[-1].append(Term(tuple((x, at - found[0][1]) for x, at in found), bool(minus)))
    return tuple(tuple(b) for b in branches if b)


def _places(term: Term, index: dict[str, list[int]]) -> list[int]:
    """Positions at which a term begins."""
    (first, _), *rest = term.lexemes
    starts = index.get(first, [])
    for x, gap in rest:
        held = set(index.get(x, ()))
        starts = [p for p in starts if p + gap in held]
    return starts


def cover_rank(query: tuple[tuple[Term, ...], ...], title: str | None, body: str | None, french: bool) -> float | None:
    """Cover density of a chunk for a query, None where it does not match.

    Every shortest stretch that satisfies the query adds the harmonic mean of its weights over one plus the
    number of its words that are not in the query. Chunks that match by negation alone rank 0.
    """
    index, last = _index(title, body, french)
    return _density(query, {x: index[x] for x in _asked(query) if x in index}, last)


def _index(title: str | None, body: str | None, french: bool) -> tuple[dict[str, list[int]], int]:
    """The places of every lexeme, and the last place of the title."""
    head, last = vector(title, french)
    index: dict[str, list[int]] = {}
    for x, p in head + vector(body, french, last)[0]:
        index.setdefault(x, []).append(p)
    return index, last


def _asked(query: tuple[tuple[Term, ...], ...]) -> set[str]:
    return {x for b in query for t in b for x, _ in t.lexemes}


def _density(query: tuple[tuple[Term, ...], ...], index: dict[str, list[int]], last: int) -> float | None:
    """Cover density by the places of the query's lexemes."""
    ways = []
    for branch in query:
        if any(t.negated and _places(t, index) for t in branch):
            continue
        terms = [(_places(t, index), t.lexemes[-1][1]) for t in branch if not t.negated]
        if all(starts for starts, _ in terms):
            ways.append(terms)
    if not ways:
        return None
    ways = [w for w in ways if w]
    entries = sorted(p for held in index.values() for p in held)
    weights = list(accumulate((1 / (TITLE if p <= last else BODY) for p in entries), initial=0.0))
    total, p = 0.0, 0
    while True:
        ends = []
        for terms in ways:
            at = [bisect_left(starts, p) for starts, _ in terms]
            if all(i < len(starts) for i, (starts, _) in zip(at, terms, strict=True)):
                ends.append(max(starts[i] + size for i, (starts, size) in zip(at, terms, strict=True)))
        if not ends:
            return total
        end, begin = min(ends), -1
        for terms in ways:
            at = [bisect_right(starts, end - size) - 1 for starts, size in terms]
            if all(i >= 0 for i in at):
                begin = max(begin, min(starts[i] for i, (starts, _) in zip(at, terms, strict=True)))
        low, high = bisect_left(entries, begin), bisect_right(entries, end)
        noise = (end - begin) - (high - low - 1)
        total += (high - low) / (weights[high] - weights[low]) / (1 + max(0, noise))
        p = begin + 1


def may_match(parsed: tuple[tuple[Term, ...], ...], text: Column) -> Column:
    """Whether a text may match an English query: some alternative has the beginnings of all its words.

    A word begins with its stem but for the stem's last letter; stems of fewer than four letters may come from
    irregular words and are not asked for.
    """
    low = F.lower(text)
    asked = [[x[:-1] for t in branch if not t.negated for x, _ in t.lexemes if len(x) > 3] for branch in parsed]
    return reduce(or_, [reduce(and_, [F.contains(low, F.lit(x)) for x in words], F.lit(True)) for words in asked])


def text_rank(title: Column, body: Column, query: str | None, french: bool = False) -> Column:
    """Cover density of a title (null allowed) and a body; null without a match, and for queries without words.

    English texts that cannot match do not go to Python.
    """
    parsed = web_query(query, french)
    if not parsed:
        return F.lit(None).cast("double")

    @F.pandas_udf("double")
    def rank(titles: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else cover_rank(parsed, t, b, french) for t, b in zip(titles, bodies, strict=True)], dtype="float64")

    title, body = title.cast("string"), F.coalesce(body.cast("string"), F.lit(""))
    if not french:
        may = may_match(parsed, F.concat_ws(" ", title, body))
        title, body = F.when(may, title), F.when(may, body)
    return rank(title, body)


def text_vector(title: Column, body: Column, language: Column) -> Column:
    """What a store keeps of a title and a body: the places of every lexeme, and the last place of the title. Nulls count as empty.

    French rows have French lexemes, all others English ones.
    """

    @F.pandas_udf("last int, places array<struct<lexeme string, at array<int>>>")
    def made(titles: pd.Series, bodies: pd.Series, french: pd.Series) -> pd.DataFrame:
        found = [_index(t, b, bool(f)) for t, b, f in zip(titles, bodies, french, strict=True)]
        return pd.DataFrame({"last": [last for _, last in found], "places": [[{"lexeme": x, "at": at} for x, at in index.items()] for index, _ in found]})

    words = made(title.cast("string"), F.coalesce(body.cast("string"), F.lit("")), F.coalesce(language == "fr", F.lit(False)))
    return F.struct(words["last"].alias("last"), F.map_from_entries(words["places"]).alias("places"))


def stored_rank(stored: Column, query: str | None, french: bool = False) -> Column:
    """As ``text_rank``, over what ``text_vector`` keeps: nothing is stemmed but the query, and only matches go to Python."""
    parsed = web_query(query, french)
    if not parsed:
        return F.lit(None).cast("double")
    places = stored["places"]
    may = reduce(or_, [reduce(and_, [F.map_contains_key(places, x) for t in branch if not t.negated for x, _ in t.lexemes], F.lit(True)) for branch in parsed])
    asked = sorted(_asked(parsed))

    @F.pandas_udf("double")
    def rank(last: pd.Series, found: pd.Series) -> pd.Series:
        index = ({x: list(at) for x, at in zip(asked, row, strict=True) if at is not None} if row is not None else None for row in found)
        return pd.Series([None if i is None else _density(parsed, i, int(n)) for n, i in zip(last, index, strict=True)], dtype="float64")

    return rank(F.when(may, stored["last"]), F.when(may, F.array(*[F.try_element_at(places, F.lit(x)) for x in asked])))


def squashed(rank: Column) -> Column:
    """A rank below 0.80, whatever its size."""
    return rank / (rank + 1) * 0.80

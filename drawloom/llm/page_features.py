"""Content and link features of a page's text, over the whole text.

Disguises are undone first: invisible characters, letters set apart by dots or
the like, and digits or signs that stand for letters.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np

#: Function words of English, German, French and Spanish (fixed values).
FUNCTION_WORDS = frozenset(
    "the a an of and to is in that it for was we with on by be can from at this not as has have were are our but or its no if then once "
    "until since although which whether than so you your i they their what how why does do did all most when even both after before "
    "whose into over under per each every any some such only also between while during because off up down out about "
    "der die das und ist den dem ein eine einer mit für bei nach wir von zu im am nicht erst ohne haben wurde bleibt dass sich auf aus wird sind "
    "le la les et de du des un une est pour avec sans que a été nous en à ce dans sur plus par ne pas qui sont "
    "el los las y del una es para con sin al se su lo nos no o son fue más muy por".split()
)
#: Words of offers in the same languages (fixed values).
OFFER_WORDS = frozenset(
    "buy cheap free best sale deal deals discount top online official review reviews price prices order shop download premium trial instant "
    "certified ultimate guide near me pro new easy fast offer offers stock shipping cart size color sku "
    "home contact login sitemap archive next more categories partners "
    "kostenlos günstig kaufen angebot bester preis heute testen mieten "
    "gratuit gratuite pas cher promo meilleur prix acheter essai location "
    "gratis barato oferta mejor precio comprar prueba alquiler".split()
)
#: Signs and digits that stand for letters (fixed values).
STAND_INS = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t"})

INVISIBLE = re.compile("[­᠎​-‏⁠-⁤﻿]")
APART = re.compile(r"(?<![^\W\d_])[^\W\d_](?:([.\-_*·])[^\W\d_])(?:\1[^\W\d_])*(?![^\W\d_])")
MIXED = re.compile(r"(?<![\w@$])(?=[\w@$!+]*[^\W\d_])(?=[\w@$!+]*[@$\d])[\w@$!+]{2,}(?![\w@$])")
HINT = re.compile(r"[@$]|[^\W\d_][\d!+]|\d[^\W\d_]")
TAG = re.compile(r"<[^<>]*>")
LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w\-]+(?:\.[\w\-]+)*\.[a-z]{2,10}/\S*", re.I)
HASHTAG = re.compile(r"(?<!\S)#[^\s#]+")
GOODS = re.compile(r"\bsku\b|\b\d+\.\d\d\b", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Where a letter set apart from its neighbours may be.
APART_HINT = re.compile(r"[.\-_*·](?=[^\W\d_][.\-_*·][^\W\d_])")
#: What ends a sentence, and what else ends a part of a line.
ENDS = (". ", "! ", "? ")
PARTS = (",", ";", "|", "/", "•", "*", "·", " - ", " – ", " > ", "  ", "\t")
ANCHOR = re.compile(r"<a\s[^<>]*>[^<>]*</a>|\[[^\[\]\n]*\]\([^()\n]*\)", re.I)
TITLED = re.compile(r"\[([^\[\]\n]*)\]\([^()\n]*\)")
CODE = re.compile(r"[=(){}\[\]+*'\"_<>@]")
STATEMENT = re.compile(r"\s{4}|\t|(?:if|for|while|def|class|return|import|from|else|elif|try|with)\b.*[:@()\[\]]\s*$|(?:return|import)\s\S+|[\w.\[\]]+\s*[-+*/%|&]?=\s*\S")
NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")

NAMES = (
    "words", "function_rate", "offer_rate", "top_pair", "top_triple", "pair_repeats", "variety", "top_word", "top_three", "sorted_pairs", "capital_rate",
    "link_share", "anchor_rate", "tag_share", "goods_rate", "disguised", "short_parts", "part_repeats", "bare_share", "longest_bare",
    "sentence_share", "stuffed_sentences", "record_share", "number_rate", "line_words", "bare_units", "junk_share", "prose_share",
)


def plain(text: str) -> tuple[str, float]:
    """The text without disguises, and the share of its words that were disguised."""
    hidden = 0 if text.isascii() else len(INVISIBLE.findall(text))
    out = INVISIBLE.sub("", text) if hidden else text
    spread = [0]

    def joined(m):
        s = m.group()
        if len(s) < 5:  # e.g. or i.e. are no disguise
            return s
        spread[0] += 1
        return s.replace(m.group(1), "")

    if APART_HINT.search(out):
        out = APART.sub(joined, out)
    swapped = [0]

    def letters(m):
        s = m.group()
        inner = sum(not c.isalnum() or c.isdigit() for c in s[:-1])
        # numbers at the end (user12, w2), versions and counts are as they look
        if s[-1].isdigit() and s.rstrip("0123456789").isalpha() or not inner or s[0].isdigit() and s[1:].isdigit():
            return s
        if not s.translate(STAND_INS).isalpha():
            return s
        swapped[0] += 1
        return s.translate(STAND_INS)

    if HINT.search(out):
        out = MIXED.sub(letters, out)
    words = max(1, out.count(" ") + out.count("\n") + 1)
    return out, min(1.0, (min(hidden, words) + spread[0] + swapped[0]) / words)


#: Blanks from which a part is not looked at for being short.
SHORT = 8


def cut_at(text: str, ends: tuple[str, ...]) -> str:
    """text with a line break at each of the ends."""
    for end in ends:
        if end in text:
            text = text.replace(end, end.rstrip() + "\n" if end in ENDS else "\n")
    return text


def links_in(text: str) -> list[str]:
    return LINK.findall(text) if "/" in text or "www." in text.lower() else []


def repeated(unit: np.ndarray, what: np.ndarray, width: int, more_than: int = 1) -> np.ndarray:
    """Units in which something comes more often than that."""
    if len(what) <= more_than:
        return np.zeros(0, np.int64)
    both = np.sort(unit * width + what)
    return both[more_than:][both[more_than:] == both[:-more_than]] // width


def is_record(line: str) -> bool:
    """A line of code, of a log or of a table: many numbers or signs of code for its words, and no link, tag or goods."""
    if "<a" in line or links_in(line) or "#" in line and HASHTAG.search(line) or ("SKU" in line or "sku" in line):
        return False
    numbers = len(NUMBER.findall(line))
    return numbers >= 2 and numbers >= 0.2 * line.count(" ") or len(CODE.findall(line)) >= max(3, len(line) / 25) or bool(STATEMENT.match(line))


#: Characters of texts that are taken together, about: their words lie in arrays at once.
TOGETHER = 2_000_000


def features(text: str | None) -> list[float]:
    """NAMES as numbers; a null or empty text gives zeros."""
    return features_of([text])[0].tolist()


def features_of(texts: list[str | None]) -> np.ndarray:
    """[texts, NAMES], the texts in bounded groups."""
    parts, group, size = [], [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= TOGETHER:
            parts.append(_features(group))
            group, size = [], 0
    parts.append(_features(group))
    return np.concatenate(parts)


def _features(texts: list[str | None]) -> np.ndarray:
    pages = len(texts)
    tokens: list[str] = []  # cased words of all pages
    sizes: list[int] = []  # words of each unit
    lengths: list[int] = []  # characters of each unit
    ended: list[bool] = []
    units_of = np.zeros(pages, np.int64)
    # per page: total, linked, titled, tagged, goods, disguised, short, repeats, recorded, numbers, lines
    told = np.zeros((pages, 11))
    empty = np.array([not t or not t.strip() for t in texts], bool)
    for page, text in enumerate(texts):
        if empty[page]:
            told[page, 0] = 1
            continue
        shown, disguised = plain(text)
        kept, recorded, lines = [], 0, 0
        for line in shown.split("\n"):
            if line.strip():
                lines += 1
                if is_record(line):
                    recorded += len(line)
                    continue
            kept.append(line)
        open_text = "\n".join(kept)
        anchors = ANCHOR.findall(open_text) if "[" in open_text or "<" in open_text else []
        # of an anchor or a link with its title, the title stays among the words
        bare = TITLED.sub(r" \1 ", open_text) if "](" in open_text else open_text
        bare = TAG.sub(" ", bare) if "<" in bare else bare
        linked = sum(map(len, links_in(open_text)))
        tagged = sum(map(len, HASHTAG.findall(bare))) if "#" in bare else 0
        body = LINK.sub(" ", bare) if linked else bare
        body = HASHTAG.sub(" ", body) if tagged else body
        lined = cut_at(body, ENDS)
        units = lined.split("\n")
        found = list(map(WORD.findall, units))
        units_of[page] = len(units)
        tokens.extend(chain.from_iterable(found))
        sizes.extend(map(len, found))
        lengths.extend(map(len, units))
        ended.extend(u.rstrip()[-1:] in ".!?:" for u in units)
        parts = [p for p in map(str.strip, cut_at(lined.lower(), PARTS).split("\n")) if p]
        short = sum(k for k in (len(WORD.findall(p)) for p in parts if p.count(" ") < SHORT) if k <= 3)
        repeats = (len(parts) - sum(c == 1 for c in Counter(parts).values())) / max(len(parts), 1)
        told[page] = (
            max(len(open_text.strip()) + recorded, 1), linked, sum(map(len, anchors)), tagged, len(GOODS.findall(open_text)), disguised, short, repeats, recorded,
            len(NUMBER.findall(body)), max(lines, 1),
        )
    total, linked, titled, tagged, goods, disguised, short, repeats, recorded, numbers, lines = told.T
    # words as numbers in alphabetical order
    forms: dict[str, int] = {}
    form = np.array([forms.setdefault(t, len(forms)) for t in tokens], np.int64)
    lowered = [f.lower() for f in forms]
    names = sorted(set(lowered))
    ranks = {w: k for k, w in enumerate(names)}
    word = np.array([ranks[w] for w in lowered], np.int64)[form] if len(form) else form
    capital = np.array([f[0].isupper() for f in forms], bool)[form] if len(form) else form.astype(bool)
    width = max(len(names), 1)
    is_function = np.array([w in FUNCTION_WORDS for w in names] or [False], bool)
    is_offer = np.array([w in OFFER_WORDS for w in names] or [False], bool)
    counted = np.array([len(w) > 1 and w not in FUNCTION_WORDS for w in names] or [False], bool)
    unit_sizes, unit_lengths = np.array(sizes, np.int64), np.array(lengths, np.int64)
    unit = np.repeat(np.arange(len(unit_sizes)), unit_sizes)
    page_of_unit = np.repeat(np.arange(pages), units_of)
    page = page_of_unit[unit] if len(unit) else unit
    n = np.bincount(page, minlength=pages)
    m = np.maximum(n, 1)
    function = is_function[word] if len(word) else word.astype(bool)
    per_page = lambda at, weight=None: np.bincount(at, weight, pages) if len(at) else np.zeros(pages)
    n_function = per_page(page, function)
    content = np.maximum(n - n_function, 1)
    # words of a page and how often
    own, back, own_counts = np.unique(page * width + word, return_inverse=True, return_counts=True)
    own_page, own_counts = own // width, own_counts * counted[own % width]
    order = np.lexsort((-own_counts, own_page))
    rank = np.arange(len(order)) - np.searchsorted(own_page, own_page[order], "left") if len(order) else order
    top_word = most(own_page, own_counts, pages)
    top_three = per_page(own_page[order], own_counts[order] * (rank < 3))
    variety = per_page(own_page, own_counts > 0)
    # pairs and triples of neighbouring words of a page
    near = np.flatnonzero(page[1:] == page[:-1])
    kinds, pair = np.unique(word[near] * width + word[near + 1], return_inverse=True)
    pair_keys, pair_counts = np.unique(page[near] * max(len(kinds), 1) + pair, return_counts=True)
    pair_page, pair_kind = pair_keys // max(len(kinds), 1), kinds[pair_keys % max(len(kinds), 1)] if len(kinds) else pair_keys
    bare_pair = ~is_function[pair_kind // width] & ~is_function[pair_kind % width] if len(pair_kind) else pair_kind.astype(bool)
    top_pair = most(pair_page, pair_counts * bare_pair, pages)
    pair_repeats = per_page(pair_page, pair_counts * (pair_counts > 1)) / np.maximum(n - 1, 1)
    joined = np.flatnonzero(near[1:] == near[:-1] + 1)
    kinds3, triple = np.unique(pair[joined] * width + word[near[joined] + 2], return_inverse=True)
    triple_keys, triple_counts = np.unique(page[near[joined]] * max(len(kinds3), 1) + triple, return_counts=True)
    top_triple = most(triple_keys // max(len(kinds3), 1), triple_counts, pages)
    rising = per_page(page[near], word[near] <= word[near + 1]) / np.maximum(n - 1, 1)
    # words with no function word among the four before and after
    upto = np.concatenate([[0], np.cumsum(function)])
    ends = np.cumsum(n)
    place = np.arange(len(word))
    alone = upto[np.minimum(place + 5, ends[page])] == upto[np.maximum(place - 4, ends[page] - n[page])] if len(word) else function
    breaks = np.flatnonzero(~alone[1:] | ~alone[:-1] | (page[1:] != page[:-1])) + 1
    run_starts = np.concatenate([[0], breaks]).astype(np.int64) if len(word) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([run_starts, [len(word)]])) * alone[run_starts] if len(word) else run_starts
    longest = most(page[run_starts], runs, pages)
    # sentences and other units of a line, told by their words
    rate = np.bincount(unit, function, len(unit_sizes)) / np.maximum(unit_sizes, 1) if len(unit_sizes) else np.zeros(0)
    spoken = (rate >= 0.13) & (unit_sizes >= 4)
    bare_units = per_page(page_of_unit, unit_lengths * ((rate < 0.13) & (unit_sizes > 0)))
    inside = np.flatnonzero((unit[near] == unit[near + 1]) & ~function[near])
    frequent = np.flatnonzero(~function & (own_counts[back] > 2)) if len(word) else word
    stuffed = np.zeros(len(unit_sizes), bool)
    stuffed[repeated(unit[near[inside]], pair[inside], max(len(kinds), 1))] = True
    stuffed[repeated(unit[frequent], word[frequent], width, 2)] = True
    stuffed &= spoken
    prose = per_page(page_of_unit, unit_lengths * (spoken & ~stuffed))
    sentence_words = per_page(page_of_unit, unit_sizes * (spoken & np.array(ended, bool)))
    sentences = per_page(page_of_unit, unit_sizes >= 4)
    out = np.stack([
        np.log1p(n), n_function / m, per_page(page, is_offer[word] if len(word) else None) / m, top_pair / m, top_triple / m,
        pair_repeats, variety / content**0.75, top_word / content, top_three / content, rising, per_page(page, capital) / m,
        linked / total, titled / total, tagged / total, goods / m, disguised, short / m, repeats, per_page(page, alone) / m, longest / m,
        sentence_words / m, per_page(page_of_unit, stuffed) / np.maximum(sentences, 1), recorded / total, numbers / m, np.log1p(n / np.maximum(lines, 1)), bare_units / total,
        np.minimum(1.0, (linked + tagged + titled + bare_units) / total), prose / total,
    ], axis=1)
    out[empty] = 0.0
    return out


def most(at: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """The greatest value at each place, 0 where there is none."""
    out = np.zeros(size, np.int64)
    np.maximum.at(out, at, value)
    return out

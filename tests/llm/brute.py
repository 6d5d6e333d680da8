"""Plain re-statements of what the operators must return, for small tables."""

import collections
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
CONTENT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(seq, width):
    if not seq:
        return frozenset()
    return frozenset(tuple(seq[i: i + width]) for i in range(len(seq) - width + 1)) if len(seq) >= width else frozenset([tuple(seq)])


def word_shingles(text, width):
    return grams(SPACED.findall((text or "").translate(LOWER)), width)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_links(sets, num, den):
    """Links of {node: set} by den * overlap >= num * union; empty sets link with nothing."""
    holders = collections.defaultdict(list)
    for n, s in sets.items():
        for g in s:
            holders[g].append(n)
    overlaps = collections.Counter()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                overlaps[a, b] += 1
    return [(a, b) for (a, b), o in overlaps.items() if den * o >= num * (len(sets[a]) + len(sets[b]) - o)]


def hit_words(text, items, window):
    """(words, hit words, ids of items with occurring windows)."""
    words = CONTENT.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, item_text in items:
        own = CONTENT.findall((item_text or "").translate(LOWER))
        k = min(window, len(own))
        windows = {tuple(own[i: i + k]) for i in range(len(own) - k + 1)} if k else ()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i: i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(item)
    return words, hit, found


def lines(text):
    """(line number, trimmed lower-case line) of the lines that are not blank."""
    out = [(i, x.strip(" \t\n\v\f\r").translate(LOWER)) for i, x in enumerate((text or "").split("\n"))]
    return [(i, x) for i, x in out if x]

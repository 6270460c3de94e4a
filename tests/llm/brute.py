"""Plain versions of the operators, for small fixtures."""

import re
from itertools import combinations


def shingles(text, width=5):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def components(rows, width=5, percent=80):
    """``[(id, text)]`` -> sorted ``[(id, n, component)]``."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in combinations([s for s in sets if s[0] is not None], 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted(((i, len(x), None if i is None else find(i)) for i, x in sets), key=str)


def words_of(line):
    lower = "".join(c.lower() if ord(c) < 256 and c != "\xd7" and c != "ÿ" else c for c in line)
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def word_edits(x, y):
    last = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row = [i]
        for j, b in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
        last = row
    return last[-1]


def deduplicated(rows, min_words, near_words):
    """``[(id, text)]`` with unique ids -> ``{id: text}`` without later lines at most one word away."""
    lines = [(i, n, words_of(x)) for i, t in sorted(rows) for n, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= min_words]
    gone = set()
    for at, (i, n, words) in enumerate(lines):
        for j, m, other in lines[:at]:
            near = len(words) >= near_words and len(other) >= near_words
            if words == other or (near and abs(len(words) - len(other)) < 2 and word_edits(words, other) <= 1):
                gone.add((i, n))
                break
    return {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def leak_edits(item, text):
    """Fewest character edits between the item and any stretch of the text."""
    fold = lambda s: "".join(" " if c.isspace() else c.lower() if len(c.lower()) == 1 else c for c in s)
    item, text = fold(item), fold(text or "")
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def licenses(text, templates, least):
    """Units of a text with the licences they match: ``{(unit, number, license): dice}``."""

    def bigrams(t):
        lower = "".join(c.lower() if ord(c) < 256 and c not in "\xd7ÿ" else c for c in t)
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower)
        return set(zip(words, words[1:]))

    lines, paragraphs = (text or "").split("\n"), [[]]
    for at, line in enumerate(lines):
        if at and at < len(lines) - 1 and not line.strip(" \t\v\f\r"):
            paragraphs.append([])
        else:
            paragraphs[-1].append(line)
    units = [("line", i, x) for i, x in enumerate(lines)]
    units += [("paragraph", i, "\n".join(p)) for i, p in enumerate(paragraphs)] + [("text", 0, text or "")]
    out, seen = {}, set()
    for kind, number, unit in units:
        a = bigrams(unit)
        for name, template in templates:
            b = bigrams(template)
            dice = 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
            if dice >= least:
                out[kind, number, name] = max(dice, out.get((kind, number, name), 0))
    return out

"""Small inputs with every awkward row, and plain Python versions of the operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SPACE = re.compile(r"[\x20\x09-\x0d]+")

# extra columns have the names that the operators give their own results
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "doc string, kept string, copy int, n_words string, label int, score string, component_id int, _norm string"
)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), "d", "k", 7, "w", 9, "x", -1, "n")


def prose(seed, n):
    """n words, mostly rare ones, the same for the same seed."""
    state, out = seed * 2654435761 % 2**32 or 1, []
    common = "the of and to a in that is".split()
    for _ in range(n):
        state = (1103515245 * state + 12345) % 2**31
        k = state >> 8
        out.append(common[k % 8] if k % 5 < 2 else f"w{k % 9973}")
    return out


def awkward():
    base = prose(1, 400)
    near = list(base)
    near[200] = "changed"
    passage = prose(2, 70)
    rows = [
        row(10, " ".join(base)),
        row(11, " ".join(base)),  # an exact copy
        row(12, "  ".join(base)),  # the same words
        row(13, " ".join(near)),
        row(5, " ".join(prose(3, 120) + passage + prose(4, 120)), "fr", "t"),
        row(6, " ".join(prose(5, 20) + passage)),
        row(7, None),
        row(8, ""),
        row(9, " \n\t "),
        row(14, "one"),
        row(15, "one"),
        row(15, "one"),  # a repeated row
        row(16, "a " * 300),
        row(17, "x" * 5000),
        row(18, " ".join(prose(6, 6000)), None, None),  # long, no language, no source
        row(19, "éàü ÇA ß 你好 😀 <|endoftext|> 12 12 12"),
        row(20, "line one here\nline one here\n\nother"),
        row(None, "no id at all"),
        row(None, None),
    ]
    return rows


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=5):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}

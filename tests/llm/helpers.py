"""Small tables with the odd cases, and brute-force versions."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, row string, text_ string"


def documents(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names the operators also use."""
    return spark.createDataFrame([(i, t, "en", s, None, "size", "score", "row", "x") for i, t, s in rows], DOCS)


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def groups(texts, percent=75):
    """{id: least id of its component} by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    of[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}

"""Rows for the tests of this folder."""


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""))


ODD = [doc(1, None), doc(1, None), doc(None, "no id at all here"), doc(2, ""), doc(3, "one"), doc(3, "two words"), doc(4, " \t\n "), doc(5, "word " * 30000), doc(6, "é ü 日本 🙂", None, None)]


def roots(edges):
    """Smallest node reachable from every node of the edges."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}

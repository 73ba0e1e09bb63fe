import hashlib
import zlib

import pytest

from sparkpact.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, tree int, idx string, path long"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def climb(nodes):
    """The root, and for each node the (before, after) of every level."""
    paths, where = [[] for _ in nodes], [*range(len(nodes))]
    while len(nodes) > 1:
        for k, at in enumerate(where):
            low = at - at % 3
            paths[k].append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + 3])))
        nodes, where = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)], [at // 3 for at in where]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = (own, *climb([leaf(r) for r in own]))
    root, upper = climb([trees[s][1] for s in order]) if order else (None, [])
    out = []
    for s, above in zip(order, upper, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            path = path + above
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            at = leaf(r | {"text": None if r["text"] is None else r["text"].replace("\n", "")}) if hit else leaf(r)
            for a, b in path:
                at = h(a, at, b)
            out.append((r["doc_id"], leaf(r), subroot, root, h(*(a + b for a, b in path)), at, at == root))
    return out


def rows_of(n, sources):
    return [(k * 7 % (n + 3), f"text {k}\nmore" if k % 5 else None, "en" if k % 3 else None, sources[k * k % len(sources)], k, "r", k, "i", None) for k in range(n)]


ODD = [(None, None, None, None, None, "x", 1, "i", 3), (5, "a\nb", "en", None, 3, None, None, None, None), (5, "a\nb", "en", None, 3, None, None, None, None), (5, "other", "é", None, 3, None, None, None, None),
       (6, "", "en", "", 0, "x", 1, "i", 3), (7, "x" * 200_000 + "\n", "en", "ü", 1, "x", 1, "i", 3), (-8, "n\n", "en", "=", 1, "x", 1, "i", 3)]


def compare(spark, rows):
    got = sorted(map(tuple, M.audited(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert got == sorted(brute([dict(zip(names, r, strict=True)) for r in rows]), key=repr)
    return got


@pytest.mark.parametrize("rows", [ODD, ODD[:1], rows_of(2, ["a"]), rows_of(800, ["a"]), rows_of(700, ["a", "a", "b", None, "c"])], ids=["odd", "one", "two", "one group", "groups"])
def test_against_brute_force(spark, rows):
    got = compare(spark, rows)
    # rows without a line break can't be spoilt by losing it
    assert any(x[-1] for x in got)


def test_many_groups_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(M, "CHUNK", 50)
    compare(spark, rows_of(1000, [f"s{k}" for k in range(90)] + ["s0"] * 200))


def test_a_changed_or_moved_row_is_noticed(spark):
    rows = rows_of(60, ["a", "b"])
    found = {r.doc_id: r for r in M.merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    texts = [r["path"] for r in found.values()]
    fold = lambda at, path: at if not path else fold(h(bytes(path[0].before).hex(), at, bytes(path[0].after).hex()), path[1:])
    for r in found.values():
        assert fold(r.leaf, r.path) == r.root
        assert fold(h("other"), r.path) != r.root
    assert len({str(p) for p in texts}) == len(texts)


def test_empty_table(spark):
    assert M.audited(spark.createDataFrame([], SCHEMA)).count() == 0

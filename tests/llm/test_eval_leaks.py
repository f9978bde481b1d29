import random
import unicodedata

from trailbed.llm.eval_leaks import Index, fold, item_blocks, leak_report


def plain(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t or "").lower() if c.isalnum())


def brute(docs, items, w):
    grams = {}
    for i, p in items:
        p = plain(p)
        for k in range(len(p) - w + 1):
            grams.setdefault(p[k : k + w], set()).add(i)
    return {(d, i) for d, t in docs for x in [plain(t)] for k in range(len(x) - w + 1) for i in grams.get(x[k : k + w], ())}


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé字ﬁＡ①") for _ in range(r.randint(1, 7)))
    text = lambda n: r.choice([" ", "-", ", "]).join(word() for _ in range(n))
    items = [(i, text(40)) for i in range(12)] + [(50, None), (51, ""), (52, "short one")]
    items += [(60, items[0][1] + " tail"), (61, items[0][1])]
    docs = []
    for d in range(60):
        t = text(r.randint(0, 60))
        if d % 2:
            p = plain(r.choice(items[:12])[1])
            b = r.randint(0, len(p) - 60)
            n = r.choice([40, 49, 50, 51, 60])
            piece = p[b : b + n]
            t = text(10) + " | " + "".join(c + r.choice(["", "", " ", ".\n"]) for c in piece).upper() + " | " + t
        docs.append((d, t))
    return docs + [(100, None), (101, ""), (102, items[0][1]), (103, "a" * 5000)], items


def test_equals_brute_force(spark):
    for seed in range(3):
        docs, items = made(seed)
        df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
        it = spark.createDataFrame(items, "item_id long, passage string")
        for chars in (4_000_000, 300):
            got = [(r.doc_id, r.item_id) for r in leak_report(df, it, 50, block_chars=chars).collect()]
            assert len(got) == len(set(got)) and set(got) == brute(docs, items, 50)


def test_edits(spark):
    r = random.Random(1)
    p = "".join(r.choice("abcdefghij") for _ in range(120))
    docs = [(0, "zz" + p[10:60] + "zz"), (1, p[10:30] + "Z" + p[31:70]), (2, p[10:30] + p[31:70]), (3, p[10:30] + "zz" + p[30:70]), (4, p[10:25] + "zzzz" + p[29:45] + "zzzz" + p[49:60]), (5, p[:30])]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, p)], "item_id long, passage string")
    got = {x.doc_id: x.edits for x in leak_report(df, it, 50, edits=2).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2}


def fewest(doc, piece):
    """Edits between a piece and the nearest stretch of doc, by the plain table."""
    row = [0] * (len(doc) + 1)
    for i, c in enumerate(piece, 1):
        new = [i]
        for j, d in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edits_equal_brute_force(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdef") for _ in range(n))
    items = [(i, text(r.choice([20, 24, 40]))) for i in range(6)] + [(90, "abc"), (91, None)]
    items.append((70, items[0][1][:15] + "f" + items[0][1][15:]))
    docs = []
    for d in range(90):
        p = r.choice(items[:6])[1]
        b = r.randint(0, len(p) - 18)
        piece = list(p[b : b + r.randint(18, 24)])
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(piece))
            piece[k : k + 1] = r.choice([[], [r.choice("abcdef")], [piece[k], r.choice("abcdef")]])
        docs.append((d, r.choice(["", text(9)]) + "".join(piece) + r.choice(["", text(9)])))
    docs += [(200, ""), (201, items[0][1][:10]), (202, "f" * 300)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    want = {}
    for d, t in docs:
        for i, p in items:
            ks = [fewest(t, p[s : s + 20]) for s in range(len(p or "") - 19)]
            if ks:
                want[d, i] = min(ks)
    for edits in (0, 1, 2):
        got = {(x.doc_id, x.item_id): x.edits for x in leak_report(df, it, 20, edits=edits).collect()}
        assert got == {k: v for k, v in want.items() if v <= edits}


def test_fold_and_empty(spark):
    for t in ("A-b_C 9é", "ﬁ①Ａ字!", "", "İß", "á"):
        assert "".join(map(chr, fold(t))) == plain(t)
    none = spark.createDataFrame([], "item_id long, passage string")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert leak_report(docs, none).isEmpty() and leak_report(docs.limit(0), none).isEmpty()
    assert [len(b) for b in item_blocks(spark.createDataFrame([(i, "x" * 10) for i in range(5)], "item_id long, passage string"), 20)] == [2, 2, 1]
    assert Index([], 50, 0).hits(fold("a" * 60))[0].size == 0

import hashlib
import random
import time

from tidemark.llm import infill


def brute(i, t):
    t = t or ""
    n = len(t)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, sha(t), sha(t))
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (i, n, form, a, b - a, sha(out), sha(t))


def rows_of():
    r = random.Random(8)
    text = lambda n: "".join(r.choice("ab c<>PSM/é日😀\x00\n<") for _ in range(n))
    rows = [(i, text(r.randint(0, 60))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (None, None), (None, "abc"), (1002, "<P>"), (1003, "x<S"), (1003, "x<S"), (1004, "<<S>>"), (1005, "<M"), (1006, ">"), (1007, "日" * 70000), (-5, "negative"), (1008, "a<P̀>")]
    return rows


def test_against_slices(docs):
    rows = rows_of()
    got = sorted((tuple(r) for r in infill.fim_digest(docs(rows)).collect()), key=str)
    want = sorted((brute(i, t) for i, t in rows), key=str)
    assert got == want
    assert {w[2] for w in want} == set(infill.FORMS)
    assert infill.fim_digest(docs([])).count() == 0


def test_outputs_and_other_seeds(docs):
    rows = rows_of()
    out = infill.with_restored(infill.fim_documents(docs(rows), seed=7, plain_from=100, spm_below=50)).collect()
    assert sorted(((r["doc_id"], r["restored"]) for r in out), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    spm = sum(r["form"] == "spm" for r in out)
    assert 150 < spm < 450 and all("<M>" in r["output"] for r in out if r["form"] != "plain")


def test_restored_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([("<P>a<S>c<M>b", "psm", 1), ("<S>c<P>a<M>b", "spm", 2), ("abc", "plain", 3), (None, "psm", 4)], "output string, form string, Restored int")
    out = infill.with_restored(rows)
    assert out.columns == ["output", "form", "Restored", "_restored"] and [r["_restored"] for r in out.collect()] == ["abc", "abc", "abc", None]


def test_select_by_halving():
    r = random.Random(1)
    for _ in range(300):
        data = bytes(r.choice([65, 0x80, 0xC3]) for _ in range(r.randint(0, 70)))
        at = [k for k, b in enumerate(data) if b & 0xC0 != 0x80]
        bits = infill.mask(data, infill.STARTS)
        assert [infill.select(bits, len(data), k) for k in range(len(at) + 1)] == [*at, len(data)]


def test_a_long_text_takes_linear_time():
    data = ("word é " * 4_000_000).encode()
    start = time.time()
    n, form, a, m, out = infill.fill_in(data, 3, 1, 100, 20)
    assert infill.restore(out, form) == data and n == 28_000_000
    assert time.time() - start < 20

import random
import re

from tidemark.llm import licenses


def words(t):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(text):
    """Containment in any window of any group, windows placed as the operator says."""
    w, out = words(text), set()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            tw = words(t)
            ts = shingles(tw)
            if not ts:
                continue
            half = max(8, 1 << (len(tw) - 1).bit_length())
            best = max((len(shingles(w[s : s + 2 * half]) & ts) / len(ts) for s in range(0, max(1, len(w)), half)), default=0)
            if best >= (1 if len(tw) < 16 else 0.8):
                out.add(name)
    return ",".join(sorted(out))


def test_against_brute_force(docs, prose):
    t = {name: texts[0] for name, texts in licenses.TEMPLATES.items()}
    cut = t["MIT"].split(" ")
    edited = " ".join(cut[:20] + ["really"] + cut[20:60] + cut[62:])
    rows = [*prose, (70, "x " * 17 + t["MIT"].upper() + " y" * 40), (71, edited), (72, " ".join(cut[:30])), (73, "It is licensed under the GNU General Public License, version 3."), (74, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (75, "w " * 2040 + t["Apache-2.0"] + " z" * 2200)]
    got = {r["doc_id"]: r for r in licenses.licenses_digest(docs(rows)).collect() if r["doc_id"] is not None}
    for i, text in rows:
        if i is not None:
            assert (got[i]["licenses"], got[i]["n_words"]) == (brute(text), len(words(text))), i
    assert "MIT" in got[70]["licenses"].split(",") and "MIT" in got[71]["licenses"].split(",") and got[72]["licenses"] == ""
    assert got[73]["licenses"] == "GPL-3.0-notice" and got[74]["licenses"] == "CC-BY-NC-4.0-notice,MIT-notice" and "Apache-2.0" in got[75]["licenses"].split(",")
    assert licenses.licenses_digest(docs(rows)).count() == len(rows)


def test_every_template_is_found_where_it_is_planted(docs):
    """Whole, between other words, and with one word in 45 changed; texts of under 16 words only whole."""
    r = random.Random(3)
    assert len(licenses.TEMPLATES) >= 45
    other = lambda n: " ".join(f"o{r.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            w = text.split(" ")
            for k in range(0, len(w), 45):
                if len(w) >= 64 and k:
                    w[k] = "changed"
            want[len(rows)] = name
            rows.append((len(rows), f"{other(r.randrange(300))} {' '.join(w)} {other(r.randrange(50))}"))
    got = {x["doc_id"]: x["licenses"].split(",") for x in licenses.licenses_digest(docs(rows)).collect()}
    missed = [want[i] for i, _ in rows if want[i] not in got[i]]
    assert not missed, missed
    texts = {i: brute(t) for i, t in rows[::9]}
    assert all(",".join(got[i]) == t for i, t in texts.items())


def test_empty(docs):
    assert licenses.licenses_digest(docs([])).count() == 0
    assert licenses.licenses(docs([(1, "Released under the MIT License")]), {}).first()["found"] == []


def test_bands_keep_the_miss_below_its_bound():
    rows = [{"n_words": 170, "shingles": list(range(166))}, {"n_words": 5, "shingles": [1]}]
    for (width, bands), t in zip(licenses.groups(rows, 0.8, 1e-6), sorted(rows, key=lambda t: t["n_words"])):
        common = -(-len(t["shingles"]) * 8 // 10)
        assert (1 - common / (width - 4 + len(t["shingles"]) - common)) ** bands <= 1e-6

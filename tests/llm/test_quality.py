import random
import re
from collections import Counter

import numpy as np

from weirlog.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_statistics(spark, documents, clash):
    r = random.Random(1)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "a b"), (5, "a b c"), (6, "a b c a b c"), (7, "x x x x"), (8, "a\n a\na\n\na"), (9, "é# ü|<> z"), (10, prose(r, 30_000)), (11, "no " * 20_000)]
    for i in range(60):
        words = [r.choice("ab c d\ne f#".split(" ")) for _ in range(r.randint(0, 80))]
        rows.append((100 + i, r.choice((" ", "\n", "  ")).join(words)))
    rows += [(100, rows[20][1]), (None, "q w e q w e")]
    docs = clash(documents([(i, t, None if i == 3 else "en", None if i == 4 else "s") for i, t in rows]))
    got = quality.quality_rules(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    found = sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) for x in got), key=repr)
    assert found == sorted(((i is None, i or 0, *brute(t)) for i, t in rows), key=repr)
    assert not any(x["kept"] for x in got if x["base_failed"])


def test_outliers_by_group(spark, documents):
    r = random.Random(2)
    rows = []
    for i in range(900):
        lang = "en" if i % 3 else "de"
        text = prose(r, r.randint(60, 300))
        if i % 15 == 0:
            text = " ".join(w + r.choice("#$%&") * 3 for w in text.split())
        elif i % 15 == 7:
            text = " | ".join(text.split())
        elif i % 15 == 9:
            text = "!! ".join(text.upper().split())
        rows.append((i, text, lang, "s" if lang == "de" else "t"))
    got = {x["doc_id"]: x["kept"] for x in quality.quality_rules(documents(rows)).collect()}
    junk = {i for i, *_ in rows if i % 15 in (0, 7, 9)}
    assert not any(got[i] for i in junk)
    assert sum(not got[i] for i in got if i not in junk) <= 2


def test_repeated_lines_stay(spark, documents):
    r = random.Random(3)
    line = prose(r, 9)
    rows = [(i, (f"{line}\n" if i % 2 else "") + prose(r, 120) + (f"\n{line}" if i % 4 == 1 else "")) for i in range(400)]
    assert all(x["kept"] for x in quality.quality_rules(documents(rows)).collect())


def test_extreme_repeats_alone_go(spark, documents):
    r = random.Random(4)
    rows = [(i, prose(r, r.randint(60, 300)), "en", "s") for i in range(400)]
    line, part = prose(r, 3), prose(r, 98)
    rows.append((1000, "\n".join([prose(r, 700), *[line] * 199]), "en", "s"))  # nearly all lines are repeats, under half of the words
    rows.append((1001, f"{part} {part} " + prose(r, 204), "en", "s"))  # 49% repeated words
    got = {x["doc_id"]: x for x in quality.quality_rules(documents(rows)).collect()}
    assert not got[1000]["base_failed"] and not got[1001]["base_failed"]
    assert not got[1000]["kept"] and not got[1001]["kept"]
    assert sum(not x["kept"] for x in got.values()) <= 4


def test_small_source_has_its_own_estimate(spark, documents):
    r = random.Random(5)
    rows = [(i, prose(r, r.randint(60, 300)), "en", "hot") for i in range(400)]
    rows += [(1000 + i, prose(r, r.randint(60, 300)).upper(), "en", "small") for i in range(40)]
    got = {x["doc_id"]: x["kept"] for x in quality.quality_rules(documents(rows)).collect()}
    assert sum(not got[i] for i in got if i >= 1000) <= 1


def plain_distances(x, tries):
    """Log determinant and distances of the best of many random starts, each concentrated until it settles."""
    r = np.random.default_rng(7)
    floors, core, p = np.array(list(quality.FEATURES.values())), quality.CORE, x.shape[1]
    wider = core / quality._chi2_share(quality._chi2(core, p), p + 2)
    best = None
    for _ in range(tries):
        part, last = x[r.choice(len(x), p + 1, replace=False)], None
        for _ in range(50):
            mean, cov = part.mean(0), np.cov(part.T, bias=True) * wider + np.diag(floors**2)
            d = np.sqrt(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))
            steps = np.round(d * quality.GRAIN)
            part = x[steps <= np.sort(steps)[int(np.ceil(core * len(x))) - 1]]
            det = np.linalg.slogdet(cov)[1]
            if last is not None and abs(det - last) < 1e-9:
                break
            last = det
        if best is None or det < best[0]:
            best = det, d
    return best


def test_smallest_determinant(spark, documents):
    r = random.Random(6)
    rows = []
    for i in range(160):
        text = prose(r, r.randint(60, 300))
        if i % 10 < 4:  # two fifths are shouted and full of signs: the mean lies between both kinds
            text = " ".join(w.upper() + "#$" * (i % 3) for w in text.split())
        rows.append((i, text, "en", "s"))
    docs = documents(rows)
    d = quality._features(quality.statistics(docs)).withColumn("grp", quality.F.lit("g")).select("doc_id", "grp", *quality.FEATURES)
    x = np.array([[row[a] for a in quality.FEATURES] for row in d.orderBy("doc_id").collect()])
    det, far = plain_distances(x, 300)
    est = quality._concentrate(d.drop("doc_id"), quality.CORE, quality.STEPS).collect()
    assert len(est) == 1 and abs(est[0]["log_det"] - det) < 1e-3
    got = {q["doc_id"]: q for q in quality.quality_rules(docs).collect()}
    assert max(abs(got[i]["distance"] - far[i]) / far[i] for i in range(160)) < 0.01
    assert not any(got[i]["kept"] for i in got if i % 10 < 4) and sum(not got[i]["kept"] for i in got if i % 10 >= 4) <= 2


def test_quantiles():
    assert abs(quality._chi2(0.5, 6) - 5.34812) < 1e-4 and abs(quality._chi2(0.999, 6) - 22.45774) < 1e-4


def test_empty_table(spark, documents):
    assert quality.quality_rules(documents([])).count() == 0

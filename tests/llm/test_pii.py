import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from perilake.llm import pii

KINDS = ["email", "ip", "card", "phone"]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    found = []
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for rank, kind in enumerate(KINDS):
        for m in re.finditer(plain[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), rank, kind, m.end(), m[0]))
    return sorted(found)


def texts(seed=1):
    rng = random.Random(seed)
    bits = ["a.b+c@x-y.co.uk", "a@b.c_d@e.f", "@x.y", "q@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.01.1.9", "1.2.3",
            "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "12345678901234567890", "1  2", "7",
            "+1 (499) 555-6503", "+1234567890123456", "+1", "++44 20 7946 0958.", "é", "日本", "word", "\n", " ", "-", ".", "5", "00"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(300)] + ["", "9" * 3000, "a" * 5000 + "@", "1 " * 4000,
            "x@y." + "z." * 3000 + "w", "m@n.o " * 300]


def test_base_spans_equal_the_patterns(spark):
    rows = list(enumerate(texts())) + [(None, "me@a.bc"), (1000, None)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10 ** 6).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = base(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e, _ in want)
        count = Counter(x[2] for x in want)
        assert got[i].spans == joined, text
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in KINDS] == [count[k] for k in KINDS]


def brute_terms(rows, reach, min_docs, alpha):
    word = re.compile(r"[^\W\d_]{4,}")
    n_value, n_both, n_term, places = Counter(), Counter(), Counter(), defaultdict(set)
    for i, text in rows:
        spans, pairs = base(text), set()
        for s, _, kind, e, value in spans:
            for lo, hi in ((max(0, s - reach), s), (e, min(len(text), e + reach))):
                for m in word.finditer(text[lo:hi]):
                    a, b = lo + m.start(), lo + m.end()
                    if (a > lo or lo in (0, e)) and (b < hi or hi in (len(text), s)):
                        pairs.add((f"{kind}:{value.lower()}", m[0].lower(), a, b))
        n_value.update({f"{k}:{v.lower()}" for _, _, k, _, v in spans})
        n_both.update({p[:2] for p in pairs})
        n_term.update({w.lower() for w in word.findall(text)})
        for v, t, a, b in pairs:
            if not any(a < e and s < b for s, _, _, e, _ in spans):
                places[(v, t)].add((i, a, b))
    out = set()
    for (v, t), n in n_both.items():
        whole = math.log2(len(rows) / n_value[v])
        if n >= min_docs and whole > 0 and math.log2(len(rows) * n / (n_value[v] * n_term[t])) >= alpha * whole:
            out |= places[(v, t)]
    return out


def test_disclosing_terms_equal_brute_force(spark):
    rng = random.Random(8)
    common = [f"{a}{b}ish" for a in "bcdfg" for b in "aeiou"]
    people = [(f"Name{chr(97 + i)}quist", f"p{i}@mail.example.org") for i in range(6)]
    rows = []
    for i in range(200):
        words = rng.choices(common, k=30)
        if i % 3 == 0:
            name, mail = rng.choice(people)
            words[rng.randrange(30)] = f"{name} {mail}, {rng.choice(common)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(*r, "v", 2) for r in rows], "doc_id long, text string, spans string, row_hash int")
    want = brute_terms(rows, 48, 3, 0.8)
    got = {(r.doc_id, t.start, t.end) for r in pii.find_spans(df).withColumnRenamed("row_id", "doc_id").collect() for t in r.terms}
    assert got == want and len(want) > 30
    clean = pii.sanitised(df)
    assert clean.columns == df.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert not any("@" in t or "quist" in t.lower() for t in text.values())
    assert all(text[i] == t for i, t in rows if "@" not in t)


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert pii.report(spark.createDataFrame([], schema)).count() == 0
    assert pii.sanitised(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "x a@b.cd y"), (1, "x a@b.cd y"), (None, None), (1, "other")], schema)
    assert sorted(str(r.text) for r in pii.sanitised(df).collect()) == ["None", "other", "x <EMAIL> y", "x <EMAIL> y"]


def test_a_name_beside_one_value_discloses_it(spark):
    filler = [f"{a}{b}ish" for a in "bcdfg" for b in "aeiou"]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(filler, k=30))) for i in range(200)]
    rows[7] = (7, rows[7][1] + " Quirrel li@mail.example.org")
    rows[9] = (9, "Zebulon " + rows[9][1] + " bo@mail.example.org")
    got = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Quirrel" not in got[7] and "<EMAIL>" in got[7]
    assert "Zebulon" in got[9]  # one document, far from the value: no evidence
    assert all(got[i] == t for i, t in rows if i not in (7, 9))


def test_terms_far_from_their_value_are_cut_wherever_they_stand(spark):
    filler = [f"{a}{b}ish" for a in "bcdfg" for b in "aeiou"]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(filler, k=30))) for i in range(200)]
    for i in range(8):
        rows[i] = (i, f"Xu Quirrel {rows[i][1]} quirrel@mail.example.org {rows[i][1]} xu QUIRREL")
    rows[100] = (100, f"{rows[100][1]} Quirrel")
    got = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any("quirrel" in t.lower() or "xu " in t.lower() for t in got.values())
    assert got[100].startswith(rows[100][1][:-7]) and all(got[i] == t for i, t in rows if i > 7 and i != 100)


def brute_disclosed(rows, reach, window, min_docs, alpha, chance):
    """Spans of disclosing terms by the rule of the module, pair by pair."""
    word = re.compile(r"[A-Za-z]{2,}")
    n_term, seen = Counter(), defaultdict(lambda: defaultdict(list))
    for i, text in rows:
        n_term.update({w.lower() for w in word.findall(text)})
        for s, _, kind, e, value in base(text):
            sides = text[max(0, s - reach):s], text[e:e + reach]
            terms = {(m[0].lower(), s - m.start() <= reach) for m in word.finditer(text[:s]) if s - m.start() <= window}
            terms |= {(m[0].lower(), m.end() <= reach) for m in word.finditer(text[e:]) if m.end() <= window}
            seen[f"{kind}:{value.lower()}"][i].append((sides, terms))
    telling = set()
    for docs in seen.values():
        passages, n_both, n_near = defaultdict(list), Counter(), Counter()
        for i, places in docs.items():
            passages[frozenset(p[0] for p in places)].append(i)
            found = set().union(*[p[1] for p in places])
            n_both.update({t for t, _ in found})
            n_near.update({t for t, near in found if near})
        speakers = {min(x) for x in passages.values()}
        n_seen = Counter(t for i in speakers for t in {t for p in docs[i] for t, _ in p[1]})
        whole = math.log2(len(rows) / len(docs))
        for t, n in n_both.items():
            if whole <= 0 or math.log2(len(rows) * n / (len(docs) * n_term[t])) < alpha * whole:
                continue
            mean, k = len(passages) * n_term[t] / len(rows), n_seen[t]
            strewn = math.log(len(seen) * len(n_term)) + k - mean - (k * math.log(k / mean) if k else 0)
            if (k >= min_docs and k > mean and strewn <= math.log(chance)) or (
                    n_near[t] and n == n_term[t] and k + (pii.NEAR - 1) * n_near[t] >= min_docs):
                telling.add(t)
    return {(i, m.start(), m.end()) for i, text in rows for m in word.finditer(text) if m[0].lower() in telling
            and not any(m.start() < e and s < m.end() for s, _, _, e, _ in base(text))}


def test_the_whole_rule_equals_brute_force(spark):
    rng = random.Random(12)
    common = [f"{a}{b}ish" for a in "bcdfg" for b in "aeiou"]
    rare = [f"{a}{b}{c}or" for a in "klm" for b in "aeiou" for c in "stnrl"]
    people = [(f"Name{chr(97 + i)}quist", f"p{chr(97 + i)}@mail.example.org") for i in range(8)]
    texts = []
    for i in range(400):
        words = [rng.choice(rare) if rng.random() < 0.05 else rng.choice(common) for _ in range(40)]
        for _ in range(rng.choice([0, 0, 1, 3])):
            name, mail = rng.choice(people) if rng.random() < 0.7 else ("someone", f"x{rng.randrange(9)}@solo.example.org")
            words[rng.randrange(40)] = rng.choice([f"{name} {mail}", f"{mail}, of {name}", mail])
            words[rng.randrange(40)] = rng.choice([name, "10.0.0.7", "more"])
        texts.append(" ".join(words))
    rows = list(enumerate(texts + [t for t in texts[:6] for _ in range(20)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in (dict(reach=20, window=64, min_docs=3, alpha=0.8, chance=0.05), dict(reach=9, window=512, min_docs=2, alpha=0.6, chance=0.5)):
        want = brute_disclosed(rows, **how)
        got = {(r.row_id, t.start, t.end) for r in pii.find_spans(df, **how).collect() for t in r.terms}
        assert got == want and len(want) > 100


def test_chance_neighbours_stay_in_other_documents_and_copies_are_one_passage(spark):
    rng = random.Random(5)
    filler = [f"{a}{b}ish" for a in "bcdfg" for b in "aeiou"]
    rows = [(i, " ".join(rng.choices(filler, k=30))) for i in range(300)]
    rows[7] = (7, rows[7][1] + " bluor k.l@site.org")
    for i in (20, 30, 40):
        rows[i] = (i, f"the bluor parcel was sent {rows[i][1]}")
    copy = f"zanor {rows[8][1]} m.n@site.org {rows[9][1]} tenor"
    rows += [(1000 + i, copy) for i in range(9)] + [(2000, "zanor tenor " + rows[10][1])]
    got = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "bluor" in got[7] and "zanor" in got[1000] and "@" not in got[7] + got[1000]
    assert all(got[i] == t for i, t in rows if i != 7 and not 1000 <= i < 2000)


def test_a_long_text_with_many_values(spark):
    name = lambda i: "q" + "".join(chr(97 + i // 26 ** k % 26) for k in range(3)) + "z"
    text = " ".join(f"{name(i)} p{i}@m.example.org" for i in range(1500))
    rows = [(1, text)] + [(i, "plain words here") for i in range(2, 50)]
    got = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == " ".join(" <EMAIL>" for _ in range(1500)) and all(got[i] == t for i, t in rows[1:])

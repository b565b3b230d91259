"""Each training-data operator on small fixtures: nulls, empties, ties, repeated rows, and brute force."""

import hashlib
import re

import numpy as np
import pytest

from knotwork.llm import chat, grid_join, jaccard_join, minhash, mixing, packing, pii, quality, sharding, url_filter
from pyspark.sql import functions as F

from knotwork.llm.queries import oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string"
WORDS = " ".join(f"w{i}" for i in range(200))


def documents(spark, texts):
    return spark.createDataFrame([(i if i >= 0 else None, t, "en", f"src{i % 3}", 0, "x") for i, t in texts], DOCS)


CASES = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, WORDS), (5, WORDS), (6, WORDS + " tail"), (7, "A b\x0bC d e f"), (-1, "null id"), (8, "é " * 3000)]


def test_jaccard_brute(spark):
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 30, 60) for _ in range(6)]
    texts = []
    for i in range(120):
        x = base[i % 6].copy()
        x[rng.integers(0, 60, rng.integers(0, 5))] = rng.integers(0, 30)
        texts.append((i, " ".join(f"t{v}" for v in x)))
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_components(documents(spark, texts)).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in texts}
    root = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert all(got[i]["n_shingles"] == len(sets[i]) for i in sets)


def test_jaccard_links_by_a_shingle_of_two_classes(spark):
    """b links with a only; their one early common passage is in no third text, and b shares more of its prefix with d."""
    texts = []
    for case in range(5):
        say = lambda kind, n, c=case: [f"{kind}{c}_{i}" for i in range(n)]
        group, edit, passage, plate = say("t", 194), say("e", 6), say("p", 16), say("h", 184)
        a, b, d = group + edit, group[:80] + passage + group[96:] + edit, passage + plate
        texts += [a, b, d, *(group + [f"g{case}_{i}"] for i in range(8)), *(plate + [f"x{case}_{i}"] for i in range(40))]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    root = [min(k for k, r in enumerate(root) if r == x) for x in root]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(documents(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert root[1] == 0 and [got[i] for i in range(len(texts))] == root


def test_jaccard_few_links_take_no_steps(spark, monkeypatch):
    """links of one chunk are put together by one task, and candidates meet their classes and components in one join a side."""
    from knotwork.operators import components

    def none(*_, **__):
        raise AssertionError

    monkeypatch.setattr(components, "forests", none)
    texts = [(i, " ".join(f"w{i % 7}_{k}" for k in range(40)) + f" end{i}") for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(documents(spark, texts)).collect()}
    assert got == {i: i % 7 for i in range(60)}


def test_jaccard_cases(spark):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(documents(spark, CASES)).collect())
    assert len(got) == len(CASES)
    assert (1, 0, 1) in got and (2, 0, 2) in got and got.count((3, 1, 3)) == 2 and (5, 196, 4) in got and (6, 197, 4) in got


def test_grid_join_brute(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:140] = x[7] + rng.normal(size=(40, 16)).astype(np.float32) * 0.15
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None])]
    got = {r["vec_id"]: r for r in grid_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=64).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    assert [got[i]["n_links"] for i in range(300)] == s.sum(1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 905))
    assert s.sum() > 0 and len({got[i]["component_id"] for i in np.flatnonzero(s[107])} | {got[107]["component_id"]}) == 1


def test_fingerprints(spark):
    got = [r for r in minhash.fingerprints(documents(spark, CASES)).orderBy("doc_id").collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(CASES) and by[4]["fingerprint"] == by[5]["fingerprint"] and by[4]["near_next"] == 1.0 and by[2]["fingerprint"] == ""
    assert by[4]["edited_sha256"] == hashlib.sha256(WORDS.encode()[: len(WORDS) - len(WORDS) // 2] + WORDS.encode()[: len(WORDS) // 2]).hexdigest()


def test_packing(spark):
    rows = packing.pack(documents(spark, CASES), packing.default_path(), size=256).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["piece"] == 0 for r in rows) == len(CASES)


def test_plan_is_optimal_where_it_can_be():
    plan = packing.plan({6: 3, 4: 3, 5: 4, 10: 1}, 10)
    assert sum(n for _, n in plan) == 6 and all(sum(x) <= 10 for x, _ in plan)


def test_plan_searches_all_fillings():
    exact = packing.plan(dict.fromkeys([2000, 1096, 1000, 1900, 1296, 900, 1700, 1196, 1200], 1), 4096)
    assert sum(n for _, n in exact) == 3
    rng = np.random.default_rng(5)
    for _ in range(150):
        size = int(rng.integers(12, 60))
        items = sorted(map(int, rng.integers(2, size // 2 + 3, int(rng.integers(5, 11)))), reverse=True)
        counts = {x: items.count(x) for x in set(items)}
        plan = packing.plan(counts, size)
        placed = sorted((x for whole, n in plan for x in whole * n), reverse=True)
        assert placed == items and all(sum(x) <= size for x, _ in plan)
        fits = {()}  # the free rooms of all ways to place the items so far
        for x in items:
            fits = {tuple(sorted((*r[:i], r[i] - x, *r[i + 1 :]))) for r in fits for i in range(len(r)) if r[i] >= x} | {tuple(sorted((*r, size - x))) for r in fits}
            few = min(map(len, fits))
            fits = {r for r in fits if len(r) <= few + 2}
        assert sum(n for _, n in plan) == min(map(len, fits))
        assert packing.least_bins(np.array([counts.get(i, 0) for i in range(size + 1)]), size) <= min(map(len, fits))


def test_ids_of_letters_need_no_expressions(monkeypatch):
    """words of a-z pass by the normalizer and the expressions; texts are looked up together, whatever their parts."""
    import pyarrow as pa

    model = packing.tokenizer(packing.default_path())
    plain = lambda x: np.array(model.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()
    ids = packing.Ids(packing.default_path())
    ids.model = None
    assert ids("The quick, brown\nfox. THE a") == plain("The quick, brown\nfox. THE a")
    monkeypatch.setattr(packing, "CHARS", 64)
    texts = [None, "", " , .", "a  b\t\n", "It's 3rd. İstanbul, ÉCOLE. école ẞ Ⅷ", "x" * 300 + ". " + "x" * 300, "日本語。 中文, a\x0bb\x00c", "<|endoftext|> a", *(f"word{i % 7}. Say so, {i}" for i in range(90))]
    ids = packing.Ids(packing.default_path(), keep=8)
    for k in (len(texts), 5, 1):
        assert [y for i in range(0, len(texts), k) for y in ids.texts(pa.array(texts[i : i + k], pa.string()))] == [plain(x) for x in texts]


def test_tokens_equal_the_tokenizer():
    ids, model = packing.Ids(packing.default_path(), keep=8), packing.tokenizer(packing.default_path())
    for text in ["", " ", "The cat. the CAT, don't 12.5 ...", "É é ΣΑΣ́ x\ty\nz" * 3, "a" * 200]:
        assert ids(text) == np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_chat_round_trip():
    render = chat.compile_template(chat.TEMPLATE)
    turns = [("user", "\\### Assistant: </turn> ok"), ("assistant", "####</turn>: \\\\n"), ("a: b", ""), ("assistant", "")]
    text, spans = render({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == ["####</turn>: \\\\n"]


def test_templates():
    assert chat.fold(chat.parse("{{ 'a' + 1 }}{% if 1 == 2 %}x{% else %}y{% endif %}")) == ("body", [("text", "a1y")])
    assert chat.compile_template("{% set n = 'b' %}{{ n | upper }}{{ missing.deep }}")({})[0] == "B"
    for bad in ("{% for x %}", "{% if a %}", "{{ a() }}", "{{ ''.__class__.mro }}{% end %}", "{{ x | exec }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_pii_discovers_by_context(spark):
    rows = [(i, f"please call our desk on +1 (212) 555-{1000 + i} before noon") for i in range(20)]
    rows += [(100, "please call our desk on 2125559999 before noon"), (101, "nothing 2125559999x here"), (102, None), (103, "")]
    got = {r["doc_id"]: r for r in pii.extract(documents(spark, rows)).collect()}
    assert got[100]["n_found"] == 1 and got[100]["n_phone"] == 0 and got[100]["spans"].startswith("phone:24:")
    assert got[101]["n_found"] == 0 and got[102]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, rows)).collect()}
    assert clean[100] == "please call our desk on [PHONE] before noon" and clean[102] is None


def test_pii_discovers_spaced_bracketed_and_digitless(spark):
    luhn = [f"{v:016d}" for v in range(4111000000000000, 4111000000000400) if pii._luhn(f"{v:016d}")][:20]
    rows = [(i, f"please call our desk on +1 (212) 555-{1000 + i} before noon") for i in range(20)]
    rows += [(20 + i, f"you may charge card {' '.join(re.findall('....', v))} for this order") for i, v in enumerate(luhn)]
    rows += [(40 + i, f"then write mail to user{i}@example.com about it") for i in range(20)]
    unseen = {100: "(212) 555-9999", 101: "0171 234 5678", 102: "0171.234.5678", 103: "4111 0000 0000 0001", 104: "alice@localhost"}
    kind = {103: "card", 104: "email"}
    around = {"phone": "please call our desk on {} before noon", "card": "you may charge card {} for this order", "email": "then write mail to {} about it"}
    texts = {i: around[kind.get(i, "phone")].format(v) for i, v in unseen.items()}
    texts[105] = "host 10.0.0.1 0171 234 5678 of 3 (4) alice@localhost"
    got = {r["doc_id"]: r for r in pii.extract(documents(spark, rows + list(texts.items()))).collect()}
    for i, v in unseen.items():
        at = texts[i].index(v)
        assert got[i]["spans"] == f"{kind.get(i, 'phone')}:{at}:{at + len(v)}" and got[i]["n_found"] == 1
    assert got[105]["n_found"] == 0 and got[105]["spans"] == "ip:5:13"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, rows + list(texts.items()))).collect()}
    assert clean[100] == "please call our desk on [PHONE] before noon" and clean[104] == "then write mail to [EMAIL] about it"


#: The expressions of op5's contract as they stand there.
BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def test_pii_base_columns_by_the_contract(spark):
    """each count is of its own kind, and the digest of all kinds, whatever else a text holds."""
    rng = np.random.default_rng(5)
    bits = ["a@b.cd", "x.y+z@sub-1.example.org", "@", "a@b", "10.0.0.1", "1.2.3.4.5.6.7.8", "300.1.1.1", "007.08.9.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (212) 555-1000", "+49 171", "é", "\U0001f600", " ", " ", "\n", ".", "-", "٣", "0", "word"]
    texts = [None, "", "10.0.0.1", "+1 (212) 555-1000", "4111 1111 1111 1111", "a@b.cd", "a@b.cd 10.0.0.1"]
    texts += ["".join(bits[i] for i in rng.integers(0, len(bits), n)) for n in rng.integers(1, 24, 400)]
    got, seen = {r["doc_id"]: r for r in pii.extract(documents(spark, list(enumerate(texts)))).collect()}, set()
    for i, t in enumerate(texts):
        want = [(name, m.start(), m.end()) for name, (form, fits) in BASE.items() for m in re.finditer(form, t or "") if fits(m.group())]
        counts = tuple(sum(x[0] == name for x in want) for name in BASE)
        assert tuple(got[i][f"n_{name}"] for name in BASE) == counts
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        seen |= {name for name, n in zip(BASE, counts, strict=True) if n > 1}
    assert seen == set(BASE)


def test_pii_candidates_of_long_runs_are_linear():
    for text in ("a" * 10**6 + "@", "1" * 10**6, "1" * 10**6 + "x", "1." * 10**5, "1:" * 10**5 + "x", "+1" + " " * 10**6, "1 (" * 10**5, "a@" * 10**5, "(1) " * 10**5 + "2x"):
        pii._candidates(text, [])


def test_pii_long_runs_are_linear():
    for text in ("a" * 10**6 + "@", "1" * 10**6, "1." * 10**5, "+1" + " " * 10**6, "a@" * 10**5):
        pii.base_spans(text)


def test_sharding(spark):
    rows = [(i, "same" if i < 40 else f"t{i // 2}") for i in range(101)]
    got = sharding.shard(documents(spark, rows)).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())


def test_sharding_keeps_groups_together(spark):
    rows = [(i, "same" if i < 40 else f"t{i // 2}" if i < 60 else f"single {i}") for i in range(240)]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(documents(spark, rows)).collect()}
    assert len({got[i] for i in range(40)}) == 2 and all(got[i] == got[i + 1] for i in range(40, 60, 2))


@pytest.mark.xfail(reason="all documents are linked and all shards full: nothing moves back, so the large group stays spread; see README")
def test_sharding_without_room(spark):
    rows = [(i, "same" if i < 40 else f"t{i // 2}") for i in range(101)]
    got = sharding.shard(documents(spark, rows)).collect()
    assert len({r["shard"] for r in got if r["doc_id"] < 40}) <= 5


def test_sharding_swaps_between_full_shards(spark):
    texts = [f"p{i // 2}" for i in range(3000)] + [f"f{i // 5}" for i in range(1000)] + [f"b{i // 200}" for i in range(1000)]
    where, sizes = {}, [0] * 8
    for r in sharding.shard(documents(spark, list(enumerate(texts)))).collect():
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        sizes[r["shard"]] += 1
    assert sum(map(len, where.values())) <= 1.2 * len(where) and sizes == [625] * 8
    assert sharding._quotas({(0, 1): 5, (1, 2): 3, (2, 0): 4}, [0, 0, 0]) == {(0, 1): 3, (1, 2): 3, (2, 0): 3}
    assert sharding._quotas({(0, 1): 5, (1, 2): 3}, [0, 0, 2]) == {(0, 1): 2, (1, 2): 2}


def test_mixing(spark):
    got = mixing.mix(documents(spark, [(i, "a b c " * (i % 5 + 1)) for i in range(60)] + [(99, None)])).collect()
    assert got and all(0 <= r["epoch"] <= mixing.EPOCHS for r in got)
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)


def test_url_rules(spark):
    urls = ["http://a.Example.ORG/es/1?x", "https://example.org/en/12#t", "x", None, "http://shop.com/de/", "http://net.com/fr/a", "http://b.net/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(6, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
    assert got[2] == ("", "", None, "allow") == got[3] and got[4][3] == "block" and got[5][3] == "allow" and got[6][3] == "allow"


def test_url_templates_reject(spark):
    pages = spark.createDataFrame([(i, f"http://h.net/{'bad' if i % 2 else 'good'}/{i}") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels).collect()}
    assert all(v == ("block" if i % 2 else "allow") for i, v in got.items())


def test_quality(spark):
    rows = [(i, "buy now !!! " * 20 if i % 2 else "the quiet river runs by the old mill " * 5) for i in range(80)] + [(200, None), (201, "")]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(documents(spark, rows), labels).collect()}
    assert all(got[i]["predicted"] == 1 - i % 2 for i in range(80)) and got[200]["score"] == got[201]["score"]


def test_held_out_accuracy(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries()["op10_quality_classifier"](spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    held = [got[i]["predicted"] == q for i, q in labels if got[i]["held_out"]]
    assert len(held) > 50 and np.mean(held) > 0.9


def test_mixing_against_sql(spark):
    import harness

    sf = "/root/testdata/sf0.01"
    assert harness.compare(queries()["op9_source_mixing"](spark, sf), harness.connect(sf), oracle_sql()["op9_source_mixing"]) is None


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf)
        assert docs.columns == columns and 0 < docs.count() <= before, name
    assert not [r for r in docs.collect() if re.search(r"\d+\.\d+\.\d+\.\d+", r["text"]) and pii.base_spans(r["text"])]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_grid_join_shuffles_no_pairs_of_blocks(spark, monkeypatch):
    """vectors of pairs of blocks go round by round, without a shuffle, and no link is lost on the way."""
    import contextlib

    rng, plans, scratch = np.random.default_rng(3), [], grid_join.scratch
    x = rng.normal(size=(300, 12))
    x[200:] = x[:100] + 0.05 * rng.normal(size=(100, 12))

    @contextlib.contextmanager
    def watched():
        with scratch() as cut:

            def own(df, batch=None):
                plans.append(df._jdf.queryExecution().executedPlan().toString())
                return cut(df, batch)

            own.keep = cut.keep
            yield own

    monkeypatch.setattr(grid_join, "scratch", watched)
    monkeypatch.setattr(grid_join, "SENT", 40 * 12 * 8, raising=False)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["vec_id"]: r["n_links"] for r in grid_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    joins = [p for p in plans if "data2" in p]
    assert len(joins) > 5 and not any("Exchange hashpartitioning" in p or "SortMergeJoin" in p for p in joins)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.9).sum(1) - 1).tolist()))


def test_grid_join_at_the_threshold(spark):
    """Pairs at a cosine of exactly 0.9 link, whatever the other rows are; equal vectors and ids count as rows."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = [[10.0, 0.0, 0.0, 0.0, 0.0, 0.0], [9.0, 3.0, 3.0, 1.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0, 10.0, 0.0], [3.0, 3.0, 1.0, 0.0, 9.0, 0.0], *rng.normal(size=(40, 6)).tolist()]
        x += [x[7]] * 5
        got = {r["vec_id"]: r for r in grid_join.near_duplicates(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"), block=8).collect()}
        u = np.array(x)
        n = np.sqrt((u * u).sum(1))
        s = np.array([[float(a @ b) / (n[i] * n[j]) >= 0.9 for j, b in enumerate(u)] for i, a in enumerate(u)])
        np.fill_diagonal(s, False)
        root = list(range(len(x)))
        for i, j in zip(*np.nonzero(s)):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        assert s[0, 1] and s[2, 3]
        assert [got[i]["n_links"] for i in range(len(x))] == s.sum(1).tolist()
        assert [got[i]["component_id"] for i in range(len(x))] == root and all(r["kept"] == (i == root[i]) for i, r in got.items())


CLASH = ["row", "_h", "_d", "_th", "_l", "_s", "score", "rank", "found", "id", "hash", "key", "cls", "component", "stays", "th", "Tokens"]


def clashing(spark, rows):
    texts = documents(spark, rows)
    return texts.select("*", *(F.lit(f"kept {c}").alias(c) for c in CLASH if c not in texts.columns))


OPERATORS = {
    "jaccard": jaccard_join.jaccard_components,
    "pii": pii.extract,
    "redact": pii.redact,
    "mix": mixing.mix,
    "mixed": mixing.mixed,
    "shard": sharding.shard,
    "fingerprints": minhash.fingerprints,
    "pack": lambda d: packing.pack(d, packing.default_path()),
    "classify": lambda d: quality.classify(d, d.sparkSession.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")),
    "classify without labels": lambda d: quality.classify(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")),
    "urls": lambda d: url_filter.judge(d.selectExpr("doc_id as page_id", "text as url", "*"), d.sparkSession.createDataFrame([(4, None, 0)], "doc_id long, quality int, toxic int")),
    "vectors": lambda d: grid_join.near_duplicates(d.selectExpr("doc_id as vec_id", "array(cast(doc_id as float), 1f, null) as embedding", "*")),
    "chat": lambda d: chat.digests(d.selectExpr("doc_id as conv_id", "0 as turn", "lang as role", "text", "source")),
    "near_duplicates": lambda d: __import__("corpus_pipeline").drop_near_duplicates(d.sparkSession, d, ""),
    "personal_data": lambda d: __import__("corpus_pipeline").mask_personal_data(d.sparkSession, d, ""),
    "mixing": lambda d: __import__("corpus_pipeline").mix_sources(d.sparkSession, d, ""),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_all_cases(spark, name):
    """Nulls, empty and long texts, ties, repeated rows and clashing names; and the empty table."""
    d, run = clashing(spark, CASES), OPERATORS[name]
    rows = run(d).collect()
    assert rows and run(d.where("false")).count() == 0
    if name in ("redact", "mixed", "near_duplicates", "personal_data", "mixing"):
        assert run(d).columns == d.columns and all(r[c] == f"kept {c}" for r in rows for c in CLASH if c != "rank")
    elif name not in ("mix", "pack", "chat"):
        assert len(rows) == len(CASES)


def test_quality_without_labels_scores_half(spark):
    assert {r["score"] for r in OPERATORS["classify without labels"](documents(spark, CASES)).collect()} == {0.5}


def test_near_duplicates_of_repeated_ids(spark):
    import corpus_pipeline

    other = " ".join(f"v{i}" for i in range(200))
    rows = [(1, WORDS), (1, other), (2, WORDS + " x"), (2, WORDS + " x"), (3, other), (4, None), (4, None), (5, "alone here"), (5, "alone here")]
    kept = sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "").collect())
    assert kept == sorted([(1, WORDS), (1, other), (4, ""), (4, ""), (5, "alone here")])


def test_url_templates_need_evidence_and_any_depth(spark):
    """Bad pages below level 8; a branch without labels neither merges nor is blocked; a tie of good and bad is allowed."""
    deep = "/".join("abcdefghij")
    kinds = [f"{deep}/bad", f"{deep}/good", "fresh", "tie"]
    urls = [(i, f"http://h.net/{kinds[i % 4]}/{i // 4}") for i in range(160)]
    marks = [(i, 0 if i % 4 == 0 or i % 8 == 3 else 1, 0) for i in range(80) if i % 4 != 2]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i]["verdict"] == ("block" if i % 4 == 0 else "allow") for i in got)
    assert got[0]["template"].endswith("/i/j/bad/{n}") and got[2]["template"] == "/fresh/{n}"

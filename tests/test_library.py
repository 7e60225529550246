"""Functions and operators of the library on micro-cases."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from claimspan.functions import jsonrepair, similarity, text
from claimspan.operators import claims, documents, freetext, generate, grounding, metrics, stats, verify
from claimspan.plans import schema
from claimspan.sources import reports


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


# ---- text


def test_technique_ids(spark):
    ids = ["t1566.1", "T1566.001", " t1566 ", None, ""]
    assert column(spark, ids, text.pad_technique_id) == ["T1566.001", "T1566.001", "T1566", None, ""]
    assert column(spark, ids, lambda c: text.pad_technique_id(c, True)) == ["t1566.001", "T1566.001", "T1566", None, ""]


def test_strip_and_tokens(spark):
    assert column(spark, ["\t a b\u00a0\n", "x"], text.strip) == ["a b", "x"]
    assert column(spark, ["The actor_1 used É-mail, and the É!", ""], text.tokens) == [["actor_1", "é", "mail", "é"], []]
    assert column(spark, ["one two three four", "one two three four five"], text.too_short) == [True, False]
    assert len(text.STOP_WORDS) == 57


def test_indicators(spark):
    sample = ["IP: 10.0.0.1 and 256.1.1.1 at https://x.y/z?q=\"v\" cve-2024-1234", "d41d8cd98f00b204e9800998ecf8427e" + " " + "a" * 40]
    assert column(spark, sample, text.ip_addresses)[0] == ["10.0.0.1"]
    assert column(spark, sample, lambda c: text.ip_addresses(c, True))[0] == ["IP: 10.0.0.1"]
    assert column(spark, sample, text.urls)[0] == ["https://x.y/z?q="]
    assert column(spark, sample, text.cves)[0] == ["CVE-2024-1234"]
    assert column(spark, sample, lambda c: text.hashes(c, 32))[1] == ["d41d8cd98f00b204e9800998ecf8427e"]
    assert column(spark, ["a" * 32, "abc", "a" * 128], text.hash_type) == ["MD5", "SHA256", "SHA512"]
    assert column(spark, ["C2.Evil.org or github.com"], text.domains) == [["c2.evil.org"]]


def test_partial_dates(spark):
    assert [str(d) for d in column(spark, ["2024-05-06", "2024-05", "2024-Q3", "2024", "soon", "2024-13-01"], text.partial_date)] == ["2024-05-06", "2024-05-01", "2024-07-01", "2024-01-01", "None", "None"]


# ---- similarity


def test_word_for_word_window_scores_a_half(spark):
    row = spark.createDataFrame([(["alpha", "beta", "gamma", "delta", "kappa"], [f"w{i}" for i in range(30)] + ["alpha", "beta", "gamma", "delta", "kappa"] + [f"v{i}" for i in range(30)])], "s array<string>, d array<string>")
    assert row.select(similarity.window_jaccard(F.col("s"), F.col("d"))).first()[0] == 0.5


def test_snippet_similarity(spark):
    rows = spark.createDataFrame([("  ", "x"), ("Brown FOX", "the brown fox ran"), ("nothing alike here", "the brown fox ran")], "s string, d string")
    assert [r[0] for r in rows.select(similarity.snippet_similarity(F.col("s"), F.col("d"))).collect()] == [0.0, 1.0, 0.0]


def test_lcs_and_rouge(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for _ in range(40)]

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [r[1] for r in rows.select("i", similarity.lcs_length(F.col("a"), F.col("b"))).orderBy("i").collect()]
    assert got == [slow(a, b) for a, b in pairs] == [similarity.lcs_of(a, b) for a, b in pairs]
    r = spark.createDataFrame([("the cats sat", "the cat sat down"), ("", "x"), (None, "x")], "a string, b string")
    assert [round(x[0], 4) for x in r.select(similarity.rouge_l(F.col("a"), F.col("b"))).collect()] == [round(4 / 7, 4), 0, 0]
    assert [round(x[0], 4) for x in r.select(similarity.rouge_l(F.col("a"), F.col("b"), stemmed=True)).collect()] == [round(6 / 7, 4), 0, 0]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("electrical", "electr"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("sky", "sky")])
def test_porter(word, stem):
    assert similarity.porter_stem(word) == stem


# ---- JSON


def test_repair(spark):
    cases = ['x {"a":1} y', '{"a": "C:\\Users",}', '{"a": 1\n "b": 2}', '{"a":1} {"b":2}', "nothing", '{"a": 1', None]
    got = column(spark, cases, jsonrepair.repair)
    assert [r["strategy"] for r in got] == ["direct", "sanitised", "commas", "prefix", None, None, None]
    assert [json.loads(r["json"]) if r["json"] else None for r in got[:4]] == [{"a": 1}, {"a": "C:\\Users"}, {"a": 1, "b": 2}, {"a": 1}]


def document(**changes):
    d = {"report_metadata": {"report_type": "campaign"}, "indicators_of_compromise": {"ip_addresses": [{"value": "1.2.3.4", "evidence_snippet": "s"}]}, "summary": "", "extra": 1}
    return json.dumps({**d, **changes})


def test_validation_rules(spark):
    cases = {
        document(): [],
        document(report_metadata={"report_type": "novel"}): ["report_type"],
        document(summary=None): ["summary"],
        document(summary="x" * 1501): ["summary"],
        document(ttps=[{"mitre_id": "T12", "tactic": "a", "technique": "b", "evidence_snippet": "c"}]): ["ttp_id"],
        document(ttps=[{"mitre_id": None, "tactic": "", "technique": "b", "evidence_snippet": "c"}]): ["ttp_fields"],
        document(timeline=[{"date": "2024-01", "event": "e", "evidence_snippet": "s"}]): ["timeline_date"],
        document(threat_actor={"name": "x"}): ["actor_confidence"],
        document(target_sectors=["a", " "]): ["sectors"],
        "[1]": ["object"],
    }
    got = column(spark, list(cases), lambda c: schema.violations(schema.parse(c)))
    assert [[x for x in g if x not in ("report_metadata", "indicators")] if "object" not in g else ["object"] for g in got][:-1] == list(cases.values())[:-1]
    assert got[-1]


def test_sentinels(spark):
    cases = ['{"doc_id":"A","error":"x","context_overflow":true}', '{"doc_id":"A","error":"x","context_overflow":false}', '{"doc_id":"A","error":"x","ttps":[]}', '{"error":"x"}', "[1,2]", "broken"]
    assert column(spark, cases, documents.is_sentinel) == [True, True, False, False, False, False]
    assert column(spark, ["_grounding_report", "DOC1_cove_log", "_cove_log", "DOC1"], documents.is_ancillary) == [True, True, True, False]


def test_coercion(spark):
    raw = document(summary=" ", report_metadata=None, ttps=[{"mitre_id": "bad", "tactic": "a", "technique": "b", "evidence_snippet": "c"}, {"mitre_id": "t1566.1", "tactic": "a", "technique": "b", "evidence_snippet": " "}], timeline=[{"date": " 2024-01-02 ", "event": "e", "evidence_snippet": "s"}])
    row = documents.parse_outputs(spark.createDataFrame([("d", "Sure: " + raw), ("e", "none")], "doc_id string, raw_output string")).orderBy("doc_id").collect()
    doc = row[0]["doc"]
    assert doc["report_metadata"]["report_type"] == "campaign" and doc["summary"] == documents.NO_SUMMARY
    assert [t["mitre_id"] for t in doc["ttps"]] == [None]
    assert row[0]["violations"] == ["timeline_date"]  # kept as it was written, so the document fails
    assert row[1]["strategy"] is None and row[1]["violations"]


# ---- claims and scores


CASES = [((), (), (1, 1, 1)), ((), ("a",), (0, 0, 0)), (("a",), (), (0, 1, 0)), (("a",), ("b",), (0, 0, 0)), (("a", "b"), ("b", "c", "d"), (0.5, 0.3333, 0.4))]


def test_scores_of_every_branch(spark):
    kind = "variant string, doc_id int, kind string, type string, value string"
    system = spark.createDataFrame([("v", i, "ioc", "ip", x) for i, (s, _, _) in enumerate(CASES) for x in s], kind)
    gold = spark.createDataFrame([("g", i, "ioc", "ip", x) for i, (_, g, _) in enumerate(CASES) for x in g], kind)
    pairs = spark.createDataFrame([("v", i) for i in range(len(CASES))], "variant string, doc_id int")
    scored = metrics.prf1(metrics.counts(system, gold, pairs, ["ioc"])).orderBy("doc_id")
    assert [(r["precision"], r["recall"], r["f1"]) for r in scored.collect()] == [c[2] for c in CASES]
    one = metrics.macro(scored.where("doc_id = 0")).first()
    assert one["std_f1"] == 0 and one["n_docs"] == 1


def test_set_operations_partition_the_claims(spark):
    rng = random.Random(2)
    make = lambda: spark.createDataFrame([(rng.randint(0, 5), "ioc", "ip", str(rng.randint(0, 9))) for _ in range(40)], "doc_id int, kind string, type string, value string")
    a, b = make().cache(), make().cache()
    n = lambda d: d.count()
    assert n(claims.intersect(a, b, "doc_id")) + n(claims.difference(a, b, "doc_id")) == n(claims.distinct_claims(a, "doc_id"))
    assert n(claims.union(a, b, "doc_id")) == n(claims.distinct_claims(a, "doc_id")) + n(claims.difference(b, a, "doc_id"))


def test_flatten_keeps_kinds_apart(spark):
    raw = document(ttps=[{"mitre_id": " t1 ", "tactic": "A", "technique": "B", "evidence_snippet": "c"}, {"tactic": "T1", "technique": "", "evidence_snippet": "c"}])
    docs = spark.createDataFrame([("d", raw), ("e", "{}")], "doc_id string, json string").select("doc_id", schema.parse(F.col("json")).alias("doc"))
    assert sorted((r["type"], r["value"]) for r in claims.flatten(docs).collect()) == [("id", "T1"), ("ip", "1.2.3.4"), ("pair", "t1\x1f")]


# ---- statistics


def test_wilcoxon_micro_cases(spark):
    d = [-0.3, 0.1, -0.2, 0.0, 0.5, 0.4, 0.6]
    rows = spark.createDataFrame([("x", v, 0.0) for v in d] + [("z", 0.0, 0.0)] * 3, "g string, a double, b double")
    x, z = stats.wilcoxon(rows, ["g"], "exact").orderBy("g").collect()
    assert (x["statistic"], x["p_value"], x["effect_size_r"], x["effect_label"]) == (5.0, 0.3125, 0.6429, "large")
    assert (z["statistic"], z["p_value"], z["effect_size_r"], z["significant"]) == (None, 1.0, 0.0, False)


def test_wilcoxon_against_all_signs(spark):
    rng = random.Random(3)
    for _ in range(5):
        d = [rng.choice([-3, -2, -1, 0, 1, 2, 3]) / 4 for _ in range(9)]
        used = [x for x in d if x]
        order = sorted(abs(x) for x in used)
        rank = {v: sum(i + 1 for i, y in enumerate(order) if y == v) / order.count(v) for v in set(order)}
        plus = sum(rank[abs(x)] for x in used if x > 0)
        w = min(plus, sum(rank.values() and [rank[abs(x)] for x in used]) - plus)
        sums = [sum(rank[abs(x)] for x, s in zip(used, signs) if s) for signs in itertools.product((0, 1), repeat=len(used))]
        p = min(1.0, 2 * sum(s <= w for s in sums) / len(sums))
        got = stats.wilcoxon(spark.createDataFrame([("x", x, 0.0) for x in d], "g string, a double, b double"), ["g"], "exact").first()
        assert got["statistic"] == w and abs(got["p_value"] - p) < 1e-12


def test_agreement_and_alpha(spark):
    a = spark.createDataFrame([("d", "x"), ("d", "x"), ("d", "y")], "doc_id string, claim string")
    b = spark.createDataFrame([("d", "y"), ("d", "z")], "doc_id string, claim string")
    assert stats.agreement(a, b).first()["agreement"] == 0.3333
    units = [("g", i, v) for i, pair in enumerate([("a", "a"), ("a", "b"), ("b", "b"), ("c", None)]) for v in pair]
    alpha = stats.nominal_alpha(spark.createDataFrame(units, "g string, pos int, value string"), ["g"]).first()["alpha"]
    assert abs(alpha - (1 - (2 / 6) / (18 / 30))) < 1e-9


# ---- free text


def test_free_text(spark):
    note = "IP: 10.0.0.1\nDOMAIN: github.com\nHASH: abc\nSUMMARY: a\nb\nCVE: cve-2024-1234\nTTP: T1566.1 initial access - mail\nTTP: T1566.1 initial access - mail\n10. Summary"
    docs = spark.createDataFrame([("d", note), ("e", "")], "doc_id string, text string")
    got = sorted((r["type"], r["value"], r["hash_type"]) for r in freetext.indicators(docs).collect())
    assert got == [("cve", "CVE-2024-1234", None), ("hash", "abc", "SHA256"), ("ip", "10.0.0.1", None)]
    literal = {r["value"] for r in freetext.indicators(docs, strict_compat=True).where("type = 'ip'").collect()}
    assert literal == {"10.0.0.1", "IP: 10.0.0.1"}
    assert [r["mitre_id"] for r in freetext.techniques(docs).collect()] == ["T1566.001", "T1566.001"]
    assert freetext.summary(freetext.lines(docs)).first()["summary"] == "a b 10. Summary"


# ---- grounding and verification


def test_passages_of_any_length_in_documents(spark):
    rng = random.Random(8)
    pieces = ["Ab", "ab", "c", "d e", "f", "gh", "ij k", "é"]
    docs = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(40)] + [(40, None), (41, "")]
    items = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 10)))) for i in range(60)] + [(60, ""), (61, None), (62, "b c d"), (63, "b")]
    items += [(100 + i, docs[i][1][3:40]) for i in range(20)]
    got = {tuple(r) for r in grounding.holds(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert got == {(i, j) for i, t in docs for j, x in items if t is not None and x and x.lower() in t.lower()}


def test_grounding_keeps_what_cannot_be_judged(spark):
    c = spark.createDataFrame([("d", "ioc", "ip", "l", i, str(i), s) for i, s in enumerate(["", "too short", "the actor sent mails with macros to banks", "a wholly different sentence about gardening tools"])], "doc_id string, kind string, type string, list string, pos int, value string, snippet string")
    docs = spark.createDataFrame([("d", "Last week THE ACTOR sent mails with macros to banks in Europe.")], "doc_id string, text string")
    assert [r["kept"] for r in grounding.ground(c, docs).orderBy("pos").collect()] == [True, True, True, False]
    assert [r["kept"] for r in grounding.ground(c, docs, strict=True).orderBy("pos").collect()] == [False, False, True, False]
    report = grounding.report(grounding.ground(c, docs)).first()
    assert (report["total_items"], report["removed_items"], report["removal_rate"]) == (4, 1, 0.25) and report["removals"][0]["value"] == "3"


def test_answers(spark):
    answers = ["Yes, it does.", "No, it is not found.", "No, the document explicitly denies it.", "Unclear.", None]
    assert column(spark, answers, lambda c: verify.supported(c, literal=True)) == [True, False, True, False, False]
    assert column(spark, answers, verify.supported) == [True, False, False, False, False]


def test_deletion_is_by_place(spark):
    c = spark.createDataFrame([("d", "ips", i, v) for i, v in enumerate(["x", "y", "x"])], "doc_id string, list string, pos int, value string")
    gone = c.where("pos = 0")
    assert [r["pos"] for r in verify.delete(c, gone).orderBy("pos").collect()] == [1, 2]
    assert verify.deleted(c, gone).count() + verify.delete(c, gone).count() == c.count()


def test_questions_first_of_equal_ones(spark):
    c = spark.createDataFrame([("d", t, f"l{t}", i, v) for t, i, v in [("tool", 0, "m"), ("ip", 1, "a"), ("ip", 0, "b"), ("ip", 2, "a"), ("path", 0, "/x")]], "doc_id string, type string, list string, pos int, value string")
    assert [(r["type"], r["pos"]) for r in verify.questions(c).orderBy("n").collect()] == [("ip", 0), ("ip", 1), ("tool", 0)]
    assert verify.questions(c, 1).count() == 1


def test_variants_with_the_stand_in(spark):
    docs = spark.createDataFrame([("a", "text one"), ("b", None)], "doc_id string, text string")
    ok, failed = generate.v1(docs)
    assert ok.count() == 1 and failed.collect()[0]["doc_id"] == "b"
    assert [x.count() for x in generate.v0(docs)] == [1, 1]  # a null prompt has no answer
    left, answers, steps = generate.v3(ok, docs)
    assert left.count() == 1 and answers.count() == 0 and steps.count() == 0


def test_verification_asks_about_techniques_and_rebuilds(spark):
    class Sceptic:
        """Says no to what names T1059 or 9.9.9.9, fails on 8.8.8.8, and yes to all else."""

        def __call__(self, prompts, **options):
            if "8.8.8.8" in prompts[0]:
                raise RuntimeError("context window")
            return ["No." if "T1059" in prompts[0] or "9.9.9.9" in prompts[0] else "Yes."]

    ips = [{"value": v, "evidence_snippet": "seen"} for v in ("1.1.1.1", "9.9.9.9", "8.8.8.8", "9.9.9.9")]
    ttps = [{"mitre_id": i, "tactic": "execution", "technique": t, "evidence_snippet": "seen"} for i, t in (("T1059", "shell"), (None, "mail"))]
    rows = [("d", document(indicators_of_compromise={"ip_addresses": ips}, ttps=ttps)), ("e", document())]
    docs = spark.createDataFrame(rows, "doc_id string, json string").select("doc_id", schema.parse(F.col("json")).alias("doc"))
    left, answers, steps = generate.v3(docs, spark.createDataFrame([("d", "text"), ("e", "text")], "doc_id string, text string"), Sceptic)
    asked = {r["question"]: r["supported"] for r in answers.where("doc_id = 'd'").collect()}
    assert len(asked) == 5 and sum("execution" in q for q in asked) == 2 and sum(v is None for v in asked.values()) == 1
    got = {r["doc_id"]: r for r in left.collect()}
    # The second 9.9.9.9 was not asked about; the address whose question failed stays.
    assert [i["value"] for i in got["d"]["doc"]["indicators_of_compromise"]["ip_addresses"]] == ["1.1.1.1", "8.8.8.8", "9.9.9.9"]
    assert [t["technique"] for t in got["d"]["doc"]["ttps"]] == ["mail"] and got["e"]["doc"] is not None
    step = {r["doc_id"]: r for r in steps.collect()}["d"]
    assert (step["n_iocs_before"], step["n_iocs_after"], step["n_ttps_before"], step["n_ttps_after"], step["n_questions"], step["n_supported"], step["n_not_supported"]) == (4, 3, 2, 1, 5, 2, 2)
    assert step["changed"] and not step["fallback"] and [x["list"] for x in step["deleted_items"]] == ["ip_addresses", "ttps"] and "NO ANSWER" in step["qa_pairs"]


def test_white_space_is_no_support(spark):
    rows = [("v", "ioc", "ip", s) for s in ("\t\n", "", " ", None, "x")] + [("v", "ioc", "tool", "")]
    claims_ = spark.createDataFrame(rows, "variant string, kind string, type string, snippet string")
    assert metrics.unsupported_rate(claims_).first()["unsupported_rate"] == 0.8


def test_commas_to_the_end_of_a_run(spark):
    gaps = "[" + "\n".join(['"a"'] * 12) + "]"
    text = spark.createDataFrame([('{"x": ' + gaps + "}",)], "t string")
    got = text.select(jsonrepair.repair(F.col("t")).alias("r")).first()["r"]
    assert got["strategy"] == "commas" and got["json"].count(",") == 11


def test_mean_alpha(spark):
    alphas = spark.createDataFrame([(0.5,), (0.9,), (None,)], "alpha double")
    assert stats.mean_alpha(alphas).first().asDict() == {"mean_alpha": 0.7, "n": 2, "acceptable": True}
    assert not stats.mean_alpha(alphas, 0.8).first()["acceptable"]


def test_exact_without_ties(spark):
    pairs = spark.createDataFrame([("g", float(i), 0.01 * i * i) for i in range(1, 31)] + [("t", float(i % 3), 0.0) for i in range(30)], "g string, a double, b double")
    assert {r["g"]: r["method"] for r in stats.wilcoxon(pairs, ["g"]).collect()} == {"g": "exact", "t": "normal"}


# ---- files


def test_files(spark, tmp_path):
    (tmp_path / "A.html").write_text("<html><head><title>T</title></head><body><nav>no</nav><article><p>one</p> <b>two</b></article></body></html>")
    (tmp_path / "B.HTM").write_text("<div role=main>only <i>this</i></div>")
    (tmp_path / "C.txt").write_text("no")
    got = {r["doc_id"]: (r["title"], r["text"]) for r in reports.load_reports(spark, str(tmp_path)).collect()}
    assert got == {"A": ("T", "one\ntwo"), "B": ("B", "only\nthis")}
    out = tmp_path / "out"
    out.mkdir()
    (out / "d1.json").write_text(document())
    (out / "d2.json").write_text("{broken")
    (out / "d3.json").write_text('{"doc_id": "d3", "error": "context window", "context_overflow": true}')
    (out / "_report.json").write_text("[]")
    ok, bad, sent = reports.load_system(spark, str(out))
    assert [[r["doc_id"] for r in x.collect()] for x in (ok, bad, sent)] == [["d1"], ["d2"], ["d3"]]
    with pytest.raises(Exception, match="invalid gold document"):
        reports.load_gold(spark, str(out)).select("doc.summary").collect()
    two = ok.union(ok.select(F.lit("d9").alias("doc_id"), "doc"))
    reports.write_documents(two.coalesce(1).withColumn("variant", F.lit("v1")), str(tmp_path / "written"))
    assert spark.read.json(str(tmp_path / "written")).first()["variant"] == "v1"
    reports.write_documents(two.coalesce(1), str(tmp_path / "again"), sent)
    back, none, failed = reports.load_system(spark, str(tmp_path / "again"))
    assert sorted(r["doc_id"] for r in back.collect()) == ["d1", "d9"] and none.count() == 0 and failed.first()["context_overflow"]
    assert back.where("doc_id = 'd1'").first()["doc"] == ok.first()["doc"]
    with pytest.raises(ValueError, match="unsupported format"):
        reports.load_reports(spark, str(tmp_path / "C.txt"), strict=True)
    found, lost = reports.find_reports(spark.createDataFrame([("A",), ("Z",)], "doc_id string"), spark.createDataFrame([("/r/A.txt",), ("/r/A.html",)], "path string"))
    assert found.first()["path"] == "/r/A.html" and lost.first()["doc_id"] == "Z"


def test_stream_equals_table(spark, tmp_path):
    from claimspan.streaming import stages

    rows = spark.createDataFrame([("a", document()), ("b", "nothing"), ("c", "x " + document())], "doc_id string, raw_output string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stages.write_stream(stages.claims_stream(stream), str(tmp_path / "claims"), str(tmp_path / "c1")).awaitTermination()
    stages.write_stream(stages.quarantine_stream(stream), str(tmp_path / "bad"), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "claims")).collect()) == ["a", "c"]
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["b"]


# ---- whole runs


def test_command_line(spark, tmp_path, capsys):
    from claimspan.__main__ import main

    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "A.html").write_text("<body>the actor used 1.2.3.4 s today</body>")
    for name, ip in (("gold", "1.2.3.4"), ("v1", "1.2.3.4"), ("v2", "9.9.9.9")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "A.json").write_text(document(summary="actors used it", indicators_of_compromise={"ip_addresses": [{"value": ip, "evidence_snippet": "s"}]}))
    main(["run", "--reports", str(tmp_path / "reports"), "--output-dir", str(tmp_path / "out")], spark)
    ran = {v: str(tmp_path / "out" / v) for v in ("v0", "v1", "v2", "v3")}
    assert [reports.load_system(spark, ran[v], v != "v0")[0].count() for v in ran] == [1, 1, 1, 1]
    main(["evaluate", "--gold", str(tmp_path / "gold"), *(x for v, p in ran.items() for x in (f"--{v}", p)), "--output", str(tmp_path / "closed")], spark)
    closed = {r["variant"]: r for r in spark.read.parquet(str(tmp_path / "closed" / "summary")).collect()}
    assert set(closed) == set(ran) and all(r["n_docs_evaluated"] == 1 for r in closed.values())
    with pytest.raises(Exception, match="(?i)path"):
        main(["evaluate", "--gold", str(tmp_path / "gold"), "--v1", str(tmp_path / "nowhere")], spark)
    main(["evaluate", "--gold", str(tmp_path / "gold"), "--v1", str(tmp_path / "v1"), "--v2", str(tmp_path / "v2"), "--output", str(tmp_path / "eval")], spark)
    got = {r["variant"]: r for r in spark.read.parquet(str(tmp_path / "eval" / "summary")).collect()}
    assert got["v1"]["macro_ioc_f1"] == 1 and got["v2"]["macro_ioc_f1"] == 0 and got["v2"]["fabrication_rate"] == 1 and got["v1"]["macro_rouge_l"] == 1
    main(["ground", "--v1-outputs", str(tmp_path / "v1"), "--reports", str(tmp_path / "reports"), "--output-dir", str(tmp_path / "ground")], spark)
    assert spark.read.parquet(str(tmp_path / "ground" / "claims")).count() == 1
    main(["agree", "--original", str(tmp_path / "gold"), "--repeat", str(tmp_path / "v2")], spark)
    assert "agreement" in capsys.readouterr().out
    with pytest.raises(ValueError, match="no pdf"):
        main(["run", "--reports", str(tmp_path / "gold"), "--output-dir", str(tmp_path / "none")], spark)


# ---- published scores, where a folder with them is named


@pytest.mark.skipif(not os.environ.get("GOLDEN_RESULTS"), reason="GOLDEN_RESULTS, GOLDEN_GOLD and GOLDEN_OUTPUTS name the files")
def test_published_scores(spark):
    want = json.load(open(os.environ["GOLDEN_RESULTS"]))
    gold = reports.load_gold(spark, os.environ["GOLDEN_GOLD"])
    checked = 0
    for variant, expected in want["variants"].items():
        ok, _, _ = reports.load_system(spark, f"{os.environ['GOLDEN_OUTPUTS']}/{variant}", validated=variant != "v0")
        docs = claims.matched(gold, ok)
        pairs = docs.select(F.lit(variant).alias("variant"), "doc_id")
        system = claims.flatten(ok.withColumn("variant", F.lit(variant)), keep_empty=variant != "v0")
        scored = metrics.prf1(metrics.counts(system, claims.flatten(docs), pairs, ["ioc", "ttp"])).collect()
        for r in scored:
            for c in ("precision", "recall", "f1"):
                assert abs(r[c] - expected["per_doc"][r["doc_id"]][f"{r['kind']}_{c}"]) <= 1.01e-4, (variant, r)
                checked += 1
        assert abs(metrics.unsupported_rate(system).first()["unsupported_rate"] - expected["unsupported_rate"]) <= 1.01e-4
    assert checked
    from claimspan.operators.evaluation import evaluate_folders

    tables = evaluate_folders(spark, os.environ["GOLDEN_GOLD"], {v: f"{os.environ['GOLDEN_OUTPUTS']}/{v}" for v in want["variants"]})
    for r in tables["per_doc"].where("kind = 'ioc'").collect():
        assert abs((r["rouge_l"] or 0.0) - want["variants"][r["variant"]]["per_doc"][r["doc_id"]]["rouge_l"]) <= 1.01e-4, r
    for r in tables["summary"].collect():
        assert r["schema_compliance"] == want["variants"][r["variant"]]["schema_compliance"]
    for kind in ("ioc", "ttp"):
        vectors = [(v, kind, f"{i:03d}", float(x)) for v, e in want["variants"].items() for i, x in enumerate(e[f"{kind}_f1_per_doc"])]
        got = stats.wilcoxon(stats.paired(spark.createDataFrame(vectors, "variant string, kind string, doc_id string, f1 double")), ["comparison"])
        got = {r["comparison"]: r for r in got.collect()}
        for e in want[f"wilcoxon_{kind}_f1"]:
            r = got["-".join(x.strip().lower() for x in e["comparison"].split("vs"))]
            assert r["statistic"] == e["statistic"] and abs(r["p_value"] - e["p_value"]) < 1e-6 and r["significant"] == e["significant"]
            assert r["effect_size_r"] == e["effect_size_r"] and r["effect_label"] == e["effect_label"]


# ---- plans of the queries


@pytest.mark.parametrize("name", ["claim_intersect", "claim_except", "claim_union", "claim_level_counts", "prf1_per_doc", "questions_topn", "targeted_deletion", "documents_without", "verification_steps"])
def test_documents_are_dealt_once_by_doc_id(spark, name):
    """Claims and documents lie by doc_id from the start; no step shuffles them again by variant, claim or question."""
    import __spark_entry__ as entry

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [part.split(",")[0].split("#")[0] for part in plan.split("hashpartitioning(")[1:]]
    assert dealt and set(dealt) == {"doc_id"}


def test_set_operations_of_documents_are_those_of_claims(spark):
    def doc(tools, cves, ttps):
        pack = lambda xs, field: [{field: x, "evidence_snippet": "s"} for x in xs]
        return json.dumps({"indicators_of_compromise": {"tools": pack(tools, "name"), "cves": pack(cves, "value")}, "ttps": [{"mitre_id": m, "tactic": t, "technique": n} for m, t, n in ttps]})

    system = [("a", 1, doc(["X", " x ", "y", None], ["cve-1"], [("t1", None, None), (None, "A", "b")])), ("b", 1, doc([], [], [])), ("a", 2, doc(["z"], [], []))]
    gold = [(1, doc(["x", "q", None], ["CVE-1", "CVE-2"], [(None, "a", "B"), ("", "c", None)])), (3, doc(["g"], [], []))]
    s = spark.createDataFrame(system, "variant string, doc_id long, j string").select("variant", "doc_id", schema.parse(F.col("j")).alias("doc"))
    g = spark.createDataFrame(gold, "doc_id long, j string").select("doc_id", schema.parse(F.col("j")).alias("doc"))
    flat = claims.flatten(s), claims.flatten(g).withColumn("variant", F.explode(F.array(F.lit("a"), F.lit("b"))))
    rows = lambda df: sorted((tuple(r) for r in df.select("variant", "doc_id", "kind", "type", "value").collect()), key=str)
    assert rows(claims.intersect_documents(s, g)) == rows(claims.intersect(*flat, "variant", "doc_id")) != []
    assert rows(claims.difference_documents(s, g)) == rows(claims.difference(*flat, "variant", "doc_id")) != []
    assert rows(claims.union_documents(s, g, ["a", "b"])) == rows(claims.union(*flat, "variant", "doc_id")) != []


def test_outputs_are_parsed_once(spark):
    """A filter on the violations must not make the document a second time, and text that a local stage repairs does not go to Python."""
    raw = spark.createDataFrame([("1", '{"summary": "x"}'), ("2", "nothing"), ("3", '{"summary": "y"} {"summary": "z"}')], "doc_id string, raw_output string")
    ok, _ = documents.split(documents.parse_outputs(raw))
    assert ok.select("doc_id", "doc.summary")._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted(((r["doc_id"], r["strategy"]) for r in documents.parse_outputs(raw).select("doc_id", "strategy").collect())) == [("1", "direct"), ("2", None), ("3", "prefix")]


def test_python_gets_a_text_once(spark):
    """Columns to drop stay out of Python, beside the prompt that holds the same text."""
    rows = spark.createDataFrame([("1", "long text"), ("2", None)], "doc_id string, text string")
    got = generate.generate(rows, F.concat(F.lit("q "), F.coalesce("text", F.lit(""))), "verify", drop=("text",))
    assert got.columns == ["doc_id", "answer", "error"] and sorted(r["answer"] in ("Yes.", "No.") for r in got.collect()) == [True, True]
    plan = generate.v1(rows)[0]._jdf.queryExecution().optimizedPlan().toString()
    first = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert first and all("text#" not in line for line in first)


def test_pages_are_read_in_slices(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"<title>t{i}</title><p>x{i}</p>" if i % 9 else None) for i in range(200)], "page_id long, html string").coalesce(1)
    got = {r["doc_id"]: (r["title"], r["text"]) for r in reports.load_html(pages, F.col("page_id"), F.col("html")).collect()}
    assert reports.PAGES < 200 and got["1"] == ("t1", "x1") and got["9"] == ("9", None) and got["199"] == ("t199", "x199") and len(got) == 200

"""Budgets against a plain water filling, exact prefixes, odd inputs."""

from fractions import Fraction

from minim.llm.mixing import budgets, grouped, mix, n_words, select_mix


def fill(budget, caps, weights):
    """Exact shares by repeated filling of whoever reaches its cap."""
    out, left, open_ = {}, Fraction(budget), {k for k in caps if weights[k] > 0}
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] >= Fraction(caps[k]) * total}
        if not full:
            out |= {k: int(left * weights[k] / total) for k in open_}
            break
        least = min(full, key=lambda k: (Fraction(caps[k], weights[k]), k))
        out[least] = caps[least]
        left -= caps[least]
        open_ -= {least}
    return {k: out.get(k, 0) for k in caps}


WEIGHTS = {"domain": {"a": 3, "b": 1, "z": 0}, "source": {"s1": 5}}


def leaves():
    return {("a", "s1"): 100, ("a", "s2"): 900, ("a", "s3"): 50, ("b", "s1"): 40, ("b", "s4"): 30, ("c", "s9"): 5000, ("z", "s1"): 700}


def table(spark):
    rows, i = [], 0
    for (d, s), tokens in leaves().items():
        while tokens:
            n = min(tokens, 1 + i % 17)
            rows.append((i, " ".join(["w"] * n), d, s))
            tokens -= n
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, domain string, source string").repartition(3), rows


def test_budgets_and_prefixes(spark):
    docs, rows = table(spark)
    for share, epochs in (((1, 2), 1), ((1, 2), 3), ((1, 1), 2), ((1, 100), 1), ((3, 1), 2)):
        wide = sum(leaves().values()) * share[0] // share[1]
        weight = {d: WEIGHTS["domain"].get(d, 1) for d in "abcz"}
        caps = {d: epochs * sum(v for k, v in leaves().items() if k[0] == d) for d in "abcz"}
        domain = fill(min(wide, sum(c for d, c in caps.items() if weight[d])), caps, weight)
        expected = {}
        for d in "abcz":
            own = {k[1]: epochs * v for k, v in leaves().items() if k[0] == d}
            expected |= {(d, s): b for s, b in fill(domain[d], own, {s: WEIGHTS["source"].get(s, 1) for s in own}).items()}
        out = mix(docs, ("domain", "source"), WEIGHTS, share, epochs)
        got = {}
        for r in out.collect():
            k = (r["domain"], r["source"])
            assert 0 <= r["prefix_tokens"] <= r["n_tokens"] and r["total_tokens"] <= epochs * r["n_tokens"]
            got[k] = got.get(k, 0) + r["total_tokens"]
        assert got == expected, (share, epochs)
    assert out.count() == len(rows)


def test_select_keeps_whole_rows_within_a_document(spark):
    docs, rows = table(spark)
    kept = select_mix(docs, ("domain", "source"), WEIGHTS, (1, 2))
    assert kept.columns == docs.columns
    words = {r[0]: len(r[1].split()) for r in rows}
    rowed = grouped(docs, ("domain", "source")).select("doc_id", "domain", "source", n_words().alias("n_tokens"))
    budget = {(r["domain"], r["source"]): r["budget"] for r in budgets(rowed, ("domain", "source"), WEIGHTS, (1, 2), 1).collect()}
    got = {}
    for r in kept.collect():
        got[r["domain"], r["source"]] = got.get((r["domain"], r["source"]), 0) + words[r["doc_id"]]
    assert all(b <= got.get(k, 0) <= b + 17 for k, b in budget.items())


def test_odd_inputs(spark, documents, empty):
    out = mix(documents)
    assert out.count() == documents.count() and out.where("lang = ''").count() > 0
    assert out.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "epochs", "prefix_tokens", "total_tokens"]
    assert mix(empty).count() == 0 and select_mix(empty).count() == 0
    assert select_mix(documents, share=(1, 1)).where("text is not null and trim(text) <> ''").count() >= documents.count() - 12
    blank = documents.selectExpr("doc_id", "cast(null as string) as text", "lang", "source")
    assert {r["total_tokens"] for r in mix(blank).collect()} == {0}


def test_repeated_and_null_ids_keep_budgets(spark):
    """Rows of one doc_id or none, equal rows among them: sums stay those of the budgets, and whole rows pass them by one row at most."""
    rows = [(None, "w " * 100, "s", "x", i) for i in range(50)] + [(7, "v " * 100, "t", "x", 1)] * 40 + [(i, "u " * (i % 9), "r", "x", i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, cut long").repartition(3)
    held = {"s": 5000, "t": 4000, "r": sum(i % 9 for i in range(100))}
    for share in ((1, 2), (1, 3), (2, 3)):
        budget = fill(sum(held.values()) * share[0] // share[1], held, dict.fromkeys(held, 1))
        got = dict.fromkeys(held, 0)
        for r in mix(docs, ("source",), share=share, max_epochs=1).collect():
            got[r["source"]] += r["total_tokens"]
        assert got == budget
        kept = select_mix(docs, ("source",), share=share)
        assert kept.schema == docs.schema
        whole = dict.fromkeys(held, 0)
        for r in kept.collect():
            whole[r["source"]] += len(r["text"].split())
        assert all(budget[s] <= whole[s] < budget[s] + 100 for s in held)


def test_clashing_columns(spark):
    names = "doc_id long, text string, lang string, source string, _mix_row long, epochs long, _tie long, _rest long, _place long, _slice long, budget long"
    docs = spark.createDataFrame([(i, "a b c", "en", "src1", *range(7)) for i in range(20)], names)
    kept = select_mix(docs)
    assert kept.schema == docs.schema and all(tuple(r)[4:] == tuple(range(7)) for r in kept.collect())

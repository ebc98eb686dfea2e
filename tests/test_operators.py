"""Unit and property tests on small literal frames."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pickwise.functions import parse as ps, text as tx
from pickwise.operators import corpus as cp, dom, evaluate as ev, features as ft, rank as rk, retrieve as rt, rules as rl, split as sp, tfidf, votes
from pickwise.operators.rows import explode_candidates
from pickwise.sources import io


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


CANDS = [("c_1", "input", "Username", "placeholder=Enter name"), ("c_2", "button", "Submit", ""), ("c_3", "select", "Country", "options=USA / UK / Canada")]
SCHEMA = "candidate_id string, tag string, text string, attrs string"


def decisions(spark, rows):
    """rows of (id, task, op, target_id, value, candidates)"""
    return spark.createDataFrame(rows, f"id long, task string, op string, target_id string, value string, cands array<struct<{SCHEMA.replace(' string', ':string')}>>")


def test_html_type_and_workflow(spark):
    assert one(spark, ps.html_type(F.lit("blah workflow-context blah current step 3 of 7 blah"))) == "workflow"
    assert one(spark, ps.html_type(F.lit("<html><body><button>Submit</button></body></html>"))) == "real_web"
    w = one(spark, ps.workflow_status(F.lit("workflow-context current step 3 of 7 Completed: Name, Date, Email")))
    assert (w["current_step"], w["total_steps"], w["completed_fields"]) == ("3", "7", ["Name", "Date", "Email"])


def test_numbered_list_and_choice(spark):
    d = decisions(spark, [(1, "t", "CLICK", "c_2", "", CANDS)])
    r = d.select(cp.format_candidates(F.col("cands")).alias("l"), *[ps.decode_choice(F.lit(c), "cands").alias(f"c{c}") for c in ("1", "2", "99", "x", "0")]).first()
    assert r["l"].split("\n") == [' 1. [input] "Username" | placeholder=Enter name', ' 2. [button] "Submit"', ' 3. [select] "Country" | options=USA / UK / Canada']
    assert [r[f"c{c}"] for c in ("1", "2", "99", "x", "0")] == ["c_1", "c_2", "", "", ""]


def test_attrs_keep_pipes_and_last_key(spark):
    a = F.lit("name=a | b | label=x=y | name=z | aria_label=Go")
    p = ps.attr_pairs(a)
    r = spark.range(1).select(p.alias("p")).select(*[ps.pair(F.col("p"), k).alias(k) for k in ("name", "label", "aria-label", "none")]).first()
    assert tuple(r) == ("z", "x=y", "Go", "")
    assert one(spark, ps.first_attr(a, "name")) == "a"


def test_unicode_words(spark):
    assert one(spark, tx.word_set(F.lit("Ünï Straße, ünï x_1"))) == ["ünï", "straße", "x_1"]


@pytest.mark.parametrize("text,mode,want", [
    ('<think>{"op":"TYPE"}</think>x {"op":"select","choice":2,"value":"a"}', "last", ("SELECT", "2", "a")),
    ('{"op":"TYPE","choice":1,"value":"v"} then {broken}', "last", ("TYPE", "1", "v")),
    ('{"op":"TYPE","choice":1,"value":"v"} {"op":"CLICK"}', "first", ("TYPE", "1", "v")),
    ('RESPONSE: {"op":"TYPE","choice":1,"value":"v"} {"op":"CLICK"}', "greedy", ("CLICK", "", "")),
    ("nothing", "last", ("CLICK", "", "")), ('{"op":"hover","choice":3,"value":"v"}', "last", ("CLICK", "3", "")),
])
def test_parse_response(spark, text, mode, want):
    assert tuple(one(spark, ps.parse_response(F.lit(text), mode))) == want


def test_malformed_candidates_are_empty(spark):
    d = spark.createDataFrame([("1", '[{"candidate_id":"a"'), ("2", None), ("3", '[{"candidate_id":7,"tag":"a"}]')], "id string, candidate_elements string")
    got = {r["id"]: r["cands"] for r in io.parse_candidates(d).collect()}
    assert got["1"] == [] and got["2"] == [] and got["3"][0]["candidate_id"] == "7"


def test_value_rules(spark):
    cand = F.struct(*[F.lit(v).alias(n) for n, v in zip(("candidate_id", "tag", "text", "attrs"), ("c", "input", "", "label=First name | name=first_name"))])
    assert one(spark, rl.value_after_label(F.lit("Fill First name: Ada and go on"), cand)) == "Ada"
    assert one(spark, rl.longest_option_in_task(F.lit("take new york city"), F.array(*map(F.lit, ("York", "New York"))))) == "New York"
    assert one(spark, rl.value_by_regex(F.lit("mail to a.b@c.org now"), F.lit("TYPE"))) == "a.b@c.org"
    assert one(spark, rl.value_by_regex(F.lit("on March 5 for Ada Lovelace"), F.lit("SELECT"))) == "March 5"
    f = rl.candidate_fields(F.struct(*[F.lit(v).alias(n) for n, v in zip(("candidate_id", "tag", "text", "attrs"), ("c", "input", "", "label=Due date"))]))
    t = F.lit("finish it on 3/4/2025 please")
    d = spark.range(1).select(f.alias("f"), t.alias("t"), tx.word_set(t).alias("w"))
    assert d.select(rl.extract_value(F.col("t"), F.lit("TYPE"), F.col("f"), F.col("w")).alias("x")).first()["x"] == "3/4/2025"


@pytest.mark.parametrize("strict", [False, True])
def test_guard_invariants(spark, strict):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        cands = [(f"c{j}", rng.choice(["input", "select", "button", "a", "div"]), rng.choice(["", "Red bolt", "Blue"]),
                  "name=x | options=Red bolt / Blue / none") for j in range(rng.randint(1, 6))]
        rows.append((i, rng.choice(["Set it to Red bolt", "click Blue", "type \"abc\""]), rng.choice(["CLICK", "TYPE", "SELECT", "hover", "type"]),
                     rng.choice([cands[0][0], cands[-1][0], "gone"]), rng.choice(["", "red BOLT", "zzz"]), cands))
    once = rl.enforce(decisions(spark, rows), strict)
    for r in once.collect():
        assert r["op"] in ("CLICK", "TYPE", "SELECT") and r["target_id"] in [c["candidate_id"] for c in r["cands"]]
        assert r["op"] != "CLICK" or r["value"] == ""
    cols = ["id", "op", "target_id", "value"]
    again = rl.enforce(once.select("id", "task", "cands", "op", "target_id", "value"), strict)
    assert sorted(map(tuple, again.select(*cols).collect())) == sorted(map(tuple, once.select(*cols).collect()))


def test_one_pick_per_decision(spark):
    d = decisions(spark, [(1, "Submit the form", "CLICK", "c_2", "", CANDS), (2, "x", "CLICK", "c_2", "", [])]).withColumn("history", F.lit(""))
    got = {r["id"]: r["pick_id"] for r in rk.pick_target(d).collect()}
    assert got == {1: "c_2", 2: ""}


# ---------------------------------------------------------------- retrieval against the sequential rule

def sequential(rows, q, k, tiers):
    words = lambda s: set(re.findall(r"\w+", s.lower()))

    def sim(a, b):
        a, b = words(a), words(b)
        return len(a & b) / len(a | b) if a and b else 0.0
    out, seen = [], set()
    for t, keys in enumerate(tiers, 1):
        block = [e for e in rows if e["id"] != q["id"] and all(e[c] == q[c] for c in keys)]
        for e in sorted(block, key=lambda e: (-sim(q["task"], e["task"]), e["id"])):
            if len(out) < k and e["id"] not in seen:
                out.append((q["id"], len(out) + 1, e["id"], t))
                seen.add(e["id"])
    return out


def test_retrieve_many_equal_tasks(spark):
    """One site holds nine of ten rows, most of them with the same task."""
    rng = random.Random(4)
    rows = [{"id": i, "site_token": "hot" if i % 10 else f"s{i % 3}", "sig": "CLICK", "html_type": "workflow", "task": "set the same thing" if i % 4 else f"set w{i % 7} w{rng.randrange(9)}"} for i in range(120)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, site_token string, sig string, html_type string, task string")
    got = sorted((r["id"], r["rank"], r["example_id"], r["tier"]) for r in rt.retrieve(df, df, 3).collect())
    assert got == sorted(x for q in rows for x in sequential(rows, q, 3, rt.TIERS))


@pytest.mark.parametrize("tiers", [rt.TIERS, rt.TIERS_EARLY])
def test_retrieve_equals_sequential(spark, tiers):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(40)]
    # one site holds most rows; one task has no word in common with any other
    rows = [{"id": i, "site_token": "hot" if i % 3 else f"s{i % 9}", "sig": rng.choice(["START", "CLICK", "TYPE"]), "html_type": rng.choice(["workflow", "real_web"]),
             "task": "lonely" if i == 7 else "" if i == 8 else " ".join(["set", "the"] + rng.sample(vocab, rng.randint(1, 6)))} for i in range(150)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, site_token string, sig string, html_type string, task string")
    got = sorted((r["id"], r["rank"], r["example_id"], r["tier"]) for r in rt.retrieve(df, df, 3, tiers=tiers).collect())
    assert got == sorted(x for q in rows for x in sequential(rows, q, 3, tiers))


def test_parts_and_cells_keep_results(spark, monkeypatch):
    monkeypatch.setattr(rt, "PART", 4)
    monkeypatch.setattr(rt, "ASKING", 3)
    test_retrieve_equals_sequential(spark, rt.TIERS)


# ---------------------------------------------------------------- white space

def test_strip_takes_all_white_space(spark):
    wild = "\t\u00a0\u3000\n"
    assert one(spark, tx.strip(F.lit(f"{wild}Save me{wild}"))) == "Save me"
    cand = F.struct(F.lit("input").alias("tag"), F.lit(f"{wild}Save{wild}").alias("text"), F.lit(f"label={wild}x").alias("attrs"))
    assert one(spark, ps.candidate_label(cand)) in ("save", "Save")
    got = one(spark, ps.attr_pairs(F.lit(f"name=\u00a0a\t | label=b{wild}")))
    assert [(p["k"], p["v"]) for p in got] == [("name", "a"), ("label", "b")]
    assert one(spark, F.transform(ps.history_steps(F.lit("Step 1: [a] \u00a0t\t -> TYPE: v1\t")), lambda s: F.concat_ws("|", s["text"], s["value"]))) == ["t|v1"]


# ---------------------------------------------------------------- page trees against a stack

def random_page(rng):
    out, open_ = [], []
    for _ in range(rng.randint(5, 40)):
        r = rng.random()
        if r < 0.55:
            t = rng.choice(["div", "p", "ul", "a"])
            open_.append(t)
            out.append(f'<{t} id="n{len(out)}">t{len(out)}')
        elif r < 0.7:
            out.append(rng.choice(["<br>", "<!-- <ul><li> -->", "<script>if(a<b){'</p>'}</script>", "<style>p<a{}</style>"]))
        else:
            out.append(f"</{open_.pop() if open_ else 'div'}>")
    return "".join(out)


def stack_paths(html):
    html = re.sub(r"<!--.*?-->", "", html)
    html = re.sub(r"(<(script|style)>).*?(</(script|style)>)", r"\1\3", html)
    path, paths, pos = [], {}, -1
    for m in re.finditer(r"<(/?)(\w+)([^>]*)>", html):
        pos += 1
        if m[1]:
            path = path[:-1]
        else:
            paths[pos] = path + [pos]
            if m[2] != "br":
                path = path + [pos]
    return paths


def test_paths_and_distance_equal_stack(spark):
    rng = random.Random(5)
    pages = [(i, random_page(rng)) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    n = dom.nodes(dom.tag_stream(df, void_leaf=True))
    got = {(r["page_id"], r["pos"]): [a["pos"] for a in r["path"]] for r in dom.with_paths(n, n).collect()}
    want = {(i, p): path for i, h in pages for p, path in stack_paths(h).items()}
    assert got == want
    pairs = [(i, *rng.sample(sorted(stack_paths(h)), 2)) for i, h in pages if len(stack_paths(h)) > 1]
    d = dom.dom_distance(n, spark.createDataFrame(pairs, "page_id long, a int, b int"))
    for r in d.collect():
        a, b = want[(r["page_id"], r["a"])], want[(r["page_id"], r["b"])]
        shared = sum(x == y for x, y in zip(a, b))
        assert r["distance"] == len(a) + len(b) - 2 * shared


# ---------------------------------------------------------------- folds, votes, TF-IDF, corpus

def test_folds_have_one_rule(spark):
    rng = random.Random(2)
    sizes = {f"g{i}": rng.randint(1, 30) for i in range(17)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "site_token string")
    order = sorted(sizes, key=lambda g: (-sizes[g], hashlib.md5(g.encode()).hexdigest(), g))
    want = {g: i % 4 if (i // 4) % 2 == 0 else 3 - i % 4 for i, g in enumerate(order)}
    assert {r["site_token"]: r["fold"] for r in sp.snake_folds(df, k=4).collect()} == want
    assert {r["site_token"]: r["fold"] for r in sp.with_fold(df, 4).collect()} == want
    loads = {r["fold"]: (r["n_groups"], r["n_rows"]) for r in sp.fold_loads(df, k=4).collect()}
    assert loads == {f: (sum(x == f for x in want.values()), sum(sizes[g] for g, x in want.items() if x == f)) for f in range(4)}


def test_row_split_is_exact(spark):
    df = spark.range(1000)
    assert sp.row_split(df, 0.2).filter("is_valid").count() == 200
    assert sp.sample_exact(df, 137).count() == 137


def test_vote_ties_go_to_lowest_fold(spark):
    v = spark.createDataFrame([(1, 0, "CLICK", "a", ""), (1, 1, "TYPE", "b", "x"), (2, 0, "TYPE", "b", "x"), (2, 1, "TYPE", "b", "x")], "id long, fold int, op string, target_id string, value string")
    got = {r["id"]: (r["op"], r["unanimous"]) for r in votes.vote(v, 2, spark.range(1, 4)).collect()}
    assert got == {1: ("CLICK", False), 2: ("TYPE", True), 3: ("CLICK", False)}


def test_char_terms(spark):
    assert sorted(one(spark, tfidf.char_terms(F.lit("Ab c")))) == sorted([" ab", "ab ", " ab ", " c "])


def test_cosine_of_equal_texts(spark):
    d = spark.createDataFrame([(1, "red bolt", "red bolt"), (2, "red bolt", "blue gear"), (3, "", "blue")], "id long, a string, b string")
    d = d.select("id", tfidf.word_terms("a").alias("a"), tfidf.word_terms("b").alias("b"))
    got = {r["id"]: round(r["cos_b"], 6) for r in tfidf.cosine(d, ("id",), "a", ("b",), tfidf.fit(d, ("id",), ("a", "b"))).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}


def test_shuffle_keeps_candidates_and_puts_same_tag_next(spark):
    cands = [(f"c{i}", "input" if i in (2, 5) else "a", "", "") for i in range(8)]
    d = decisions(spark, [(i, "t", "TYPE", "c2", "v", cands) for i in range(30)]).withColumn("html_type", F.lit("real_web"))
    rows = cp.augment_shuffle(d, 1, 3).collect()
    assert len(rows) == 90
    for r in rows:
        ids = [c["candidate_id"] for c in r["cands"]]
        assert sorted(ids) == sorted(c[0] for c in cands) and abs(ids.index("c2") - ids.index("c5")) == 1


def test_submission_problems_are_raised(spark):
    bad = spark.createDataFrame([(1, "CLICK", "a", "x")], "id long, op string, target_id string, value string")
    with pytest.raises(ValueError, match="click_with_value"):
        ev.raise_on_problems(ev.check_submission(bad))


# ---------------------------------------------------------------- session

def test_scratch_folder_must_be_shared(spark):
    """Off one machine an unset folder is an error, not a temporary folder."""
    from pickwise import session

    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Cluster)


def test_open_bins_have_no_upper_end(spark):
    from pickwise.operators import profile as pf
    d = spark.createDataFrame([(0, 1), (15, 1), (120, 0), (10_000, 1)], "n int, hit int")
    got = {r["bin"]: r["n"] for r in pf.binned_accuracy(d, "n", "hit").collect()}
    assert got == {"0-0": 1, "1-3": 0, "4-6": 0, "7-9": 0, "10-14": 0, "15+": 3}


def test_element_context_wide_parent(spark):
    """A parent with many children: three children, five neighbours, the text before."""
    html = "<div>" + "".join(f"<p>t{i}</p>" for i in range(40)) + "</div>"
    pages = spark.createDataFrame([(1, html)], "id long, html string")
    stream = dom.tag_stream(pages, "id", "html", void_leaf=True)
    me = dom.nodes(stream).select("id", F.col("pos").alias("cand_pos"), "pos")
    got = {r["cand_pos"]: r["context"] for r in dom.element_context(me, stream).collect()}
    assert got[0] == "children:[p:t0, p:t1, p:t2]"
    assert got[1] == "near:[p:t1, p:t2, p:t3, p:t4, p:t5]" and got[5] == "prev:t1 | near:[p:t0, p:t1, p:t3, p:t4, p:t5]"


def test_tfidf_fit_counts_places_and_documents(spark):
    """Totals count every place, document frequencies every array once, by the weight of its row; null terms and rows with a null array count nothing."""
    rows = [(1, 2, ["b", "a", "b"], ["b", None]), (1, 1, ["a", None, None], []), (2, 1, [], ["c", "a", "c"]), (None, 3, [], ["d"]), (3, 1, ["e"], None)]
    d = spark.createDataFrame(rows, "id int, w int, x array<string>, y array<string>")
    got = {r["term"]: (r["df"], r["total"]) for r in tfidf.fit(d, ("id",), ("x", "y"), weight="w").collect()}
    assert got == {"a": (4, 4), "b": (4, 6), "c": (1, 2), "d": (3, 3)}
    assert [r["term"] for r in tfidf.fit(d, ("id",), ("x", "y"), 2, 2, "w").collect()] == ["b", "a"]


def test_tfidf_makes_terms_once(spark):
    """One expression over the text per pass, and one row per term place for the vocabulary."""
    d = spark.createDataFrame([(1, "red red box"), (2, "red box lid")], "id int, text string")
    docs = d.select("id", tfidf.word_terms("text").alias("terms"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    vocab = tfidf.fit(docs, ("id",), ("terms",), 10, 2)
    assert "array_distinct" not in plan(vocab) and plan(vocab).count("regexp_extract_all") == 1
    assert plan(tfidf.weights(docs, ("id",), "terms", spark.createDataFrame([("red", 1.0)], "term string, idf double"))).count("regexp_extract_all") == 1
    assert {(r["term"], r["df"], r["total"]) for r in vocab.collect()} == {("red", 2, 3), ("box", 2, 2), ("red box", 2, 2)}


def test_word_ngrams(spark):
    d = spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],), (None,)], "w array<string>")
    got = [r[0] for r in d.select(tfidf.word_ngrams(F.col("w"), 3)).collect()]
    assert got == [["a", "b", "a", "a b", "b a", "a b a"], ["a"], [], None]


def test_token_set_builds_no_set_of_stop_words(spark):
    d = spark.createDataFrame([("The the map of a Map-view, x2 and x2",), ("of the and",), ("",), (None,)], "s string")
    out = d.select(tx.token_set("s", ("the", "of", "and")).alias("t"))
    assert [list(r.t) for r in out.collect()] == [["map", "map-view", "x2"], [], [], []]
    assert "array_except" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_attr_pairs_take_one_pass(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "aria_", "=", "=", "|", "|", " ", "\t", "\n", ":", "-", "é"]) for _ in range(rng.randrange(24))) for _ in range(400)] + [None]
    d = spark.createDataFrame([(t,) for t in texts], "s string").select("s", ps.attr_pairs("s").alias("p"))
    shape = re.compile(ps.ATTR_PAIR.replace(r"\s", r"[ \t\n\x0b\f\r]"))
    for r in d.collect():
        want = [(k.replace("_", "-") if k.startswith("aria_") else k, v.strip(tx.WHITE)) for k, v in shape.findall((r.s or "").strip(tx.WHITE))]
        assert [tuple(p) for p in r.p] == want, repr(r.s)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_list_shows_known_keys_in_order_and_last_value(spark):
    c = [("c", "input", "t", "zz=9 | options=o | name=a | style=s | name=b | type= | type= | id=i | class=x | yy=8 | xx=7")]
    d = decisions(spark, [(1, "t", "CLICK", "c", "", c)])
    assert d.select(cp.format_candidates(F.col("cands")).alias("l")).first()["l"] == ' 1. [input] "t" | id=i | name=b | options=o | zz=9 | yy=8'
    assert d.select(cp.format_candidates(F.col("cands"), "compact").alias("l")).first()["l"] == ' 1. [input] "t" | name=b | options=o'


def test_corpus_parses_before_it_copies(spark):
    d = decisions(spark, [(1, "Set the Country", "SELECT", "c_3", "UK", CANDS), (2, "Press", "CLICK", "c_2", "", CANDS)])
    d = d.withColumn("history", F.lit("Step 1: [input] Username -> TYPE: x")).withColumn("cleaned_html", F.when(F.col("id") == 1, "workflow-context current step 3 of 7 Completed: Name").otherwise("<p>step"))
    out = cp.build_corpus(d, "preference")
    rows = {(r["id"], r["aug"]): r for r in out.collect()}
    assert sorted(rows) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)]
    want = cp.build_prompt(d).select("id", "prompt").collect()
    assert all(rows[r["id"], 0]["prompt"] == f"### Instruction:\n{r['prompt']}\n\n### Response:\n" for r in want)
    assert "Step 3 of 7" in rows[1, 1]["prompt"] and "[Workflow Status]" not in rows[2, 0]["prompt"]
    assert "select number 3 (Country)" in rows[1, 0]["chosen"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.split("explode(sequence")[0]


def test_cosines_are_counted_in_their_row(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["red", "blue", "Grün", "box", "a", "size-9", "", "x"]) for _ in range(n))
    rows = [(i, i % 2, say(6), say(4), [(f"c{j}", "a", say(3), say(3)) for j in range(i % 4)]) for i in [*range(12), 5, 7]]
    d = spark.createDataFrame(rows, f"id long, fold int, task string, history string, cands array<struct<{SCHEMA.replace(' string', ':string')}>>")
    for folds, of in ((None, ("id", "task", "history")), (2, ("id", "fold", "task", "history"))):
        vocabs = ft.cosine_vocabs(d, folds)
        cand = explode_candidates(d, False, of)
        got, want = ft.cand_cosine(cand, *vocabs, folds), ft._shuffled_cosine(cand, *vocabs, folds)
        flat = lambda x: sorted([*map(str, r[:2]), *(round(v, 9) for v in r[2:])] for r in x.select("id", "cand_pos", *sorted(x.columns[2:])).collect())
        assert flat(got) == flat(want) and any(sum(r[2:]) > 0 for r in flat(got))
        single = ft.cand_cosine(cand.filter("id not in (5, 7)"), *vocabs, folds)
        assert "Exchange hashpartitioning" not in single._jdf.queryExecution().executedPlan().toString()

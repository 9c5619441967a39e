import itertools

import pytest
from pyspark.sql import functions as F

from shiftscope.operators import graph, observe
from shiftscope.plans.templates import Step, construction_template, relation_template, slot_columns

COLUMNS = "period string, file string, sent_seq int, file_line int, sent_id string, form string, lemma string, pos string, id string, head string, deprel string, feats string"
#: (lemma, pos, head, relation, features) of each sentence.
SENTENCES = [
    [("dog", "NOUN", 2, "nsubj", "Number=Sing"), ("bark", "VERB", 0, "root", "Mood=Ind|Tense=Pres"), ("loud", "ADV", 2, "advmod", "_")],
    [("dog", "NOUN", 3, "nsubj", "-"), ("not", "PART", 3, "advmod", "A="), ("bark", "VERB", 0, "root", "A=x|A=y|B"), ("loud", "ADV", 3, "advmod", "_"), ("very", "ADV", 4, "advmod", "_")],
    [("bark", "VERB", 0, "root", "_")],
    [("cat", "NOUN", 2, "nsubj", "_"), ("bark", "VERB", 0, "root", "_"), ("at", "ADP", 4, "case", "_"), ("dog", "NOUN", 2, "obl", "_"), ("bark", "NOUN", 9, "dep", "_")],
]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [("p1" if k < 2 else "p2", "f", k, i, f"s{k}", lemma.title(), lemma, pos, str(i + 1), str(head), rel, feats) for k, s in enumerate(SENTENCES) for i, (lemma, pos, head, rel, feats) in enumerate(s)]
    return spark.createDataFrame(rows, COLUMNS)


def adjacency(sentence):
    out = {}
    for i, (_, _, head, rel, _) in enumerate(sentence, 1):
        if head:
            out.setdefault(head, []).append((i, f"chi_{rel}"))
            out.setdefault(i, []).append((head, f"pa_{rel}"))
    return out


def walks(sentence, start, depth):
    """All simple walks of up to depth steps: (nodes, labels)."""
    near, todo, out = adjacency(sentence), [((start,), ())], []
    while todo:
        nodes, labels = todo.pop()
        out.append((nodes, labels))
        if len(labels) < depth:
            todo += [((*nodes, n), (*labels, rel)) for n, rel in near.get(nodes[-1], []) if n not in nodes]
    return out


def barks():
    return [(k, i) for k, s in enumerate(SENTENCES) for i, t in enumerate(s, 1) if t[0] == "bark" and t[1] == "VERB"]


def show(labels):
    return "> " + " > ".join(labels)


def test_prefix_and_terminal_paths(tokens):
    which = graph.targets(tokens, "bark", "VERB")
    links = graph.edges(graph.near(tokens, which))
    want = sorted(show(lab) for k, i in barks() for _, lab in walks(SENTENCES[k], i, 2) if lab)
    assert sorted(r.path for r in graph.prefix_paths(which, links, 2).collect()) == want
    end = []
    for k, i in barks():
        every = walks(SENTENCES[k], i, 2)
        for nodes, lab in every:
            if lab and (len(lab) == 2 or not any(n[: len(nodes)] == nodes and len(n) > len(nodes) for n, _ in every)):
                end.append(show(lab))
    assert sorted(r.path for r in graph.terminal_paths(which, links, 2).collect()) == sorted(end)


def test_follow_may_return(tokens):
    which = graph.targets(tokens, "dog")
    back = graph.follow(which, graph.edges(tokens), ["pa_nsubj", "chi_nsubj"]).collect()
    assert back and all(r.node == r.target for r in back)


def brute_modes(template, mode):
    """(sentence, target) and matches by trying every choice of one match a path."""
    out = set()
    for k, i in barks():
        near = adjacency(SENTENCES[k])
        options = []
        for path in template.paths:
            fit = [(n, lab) for n, lab in walks(SENTENCES[k], i, len(path)) if list(lab) == [s.relation for s in path] and all(s.pos is None or SENTENCES[k][x - 1][1] in s.pos for x, s in zip(n[1:], path))]
            options.append(fit)
        if not all(options):
            continue
        if mode == "closeh" and {r for _, r in near.get(i, [])} != {p[0].relation for p in template.paths}:
            continue
        for choice in itertools.product(*options):
            if mode == "close":
                allowed, parent = {}, {}
                for nodes, lab in choice:
                    for j, n in enumerate(nodes):
                        allowed.setdefault(n, set())
                        if j < len(lab):
                            allowed[n].add(lab[j])
                        if j:
                            parent[n] = nodes[j - 1]
                if any({r for x, r in near.get(n, []) if x != parent.get(n)} != a for n, a in allowed.items()):
                    continue
            out |= {(k, str(i), ",".join(map(str, nodes))) for nodes, _ in choice}
    return out


@pytest.mark.parametrize("mode", ["open", "closeh", "close"])
@pytest.mark.parametrize("text", ["> (chi_nsubj, []) & > (chi_advmod, [])", "> (chi_nsubj, [NOUN, PROPN]) & > (chi_advmod, [ADV])", "> (chi_nsubj, []) & > (chi_advmod, []) > (chi_advmod, [])", "> (chi_nsubj, []) & > (chi_obl, []) > (chi_case, [])"])
def test_modes(tokens, text, mode):
    t = relation_template(text)
    got = {(r.sent_seq, r.target, ",".join(r.seen)) for r in graph.matched(graph.targets(tokens, "bark", "VERB"), tokens, t, mode).collect()}
    assert got == brute_modes(t, mode)


def test_search_rows(tokens):
    rows = graph.relation_search(tokens, relation_template("> (chi_advmod, []) > (chi_advmod, [])"), "bark", fmt="lemma/deprel").collect()
    assert sorted((r.sfillers, r.path) for r in rows) == [("loud/advmod", "> chi_advmod"), ("very/advmod", "> chi_advmod > chi_advmod")]
    rows = graph.construction_search(tokens, construction_template("(VERB) & > (chi_obl, [])"), fmt="lemma/deprel").collect()
    assert sorted((r.sfillers, r.path) for r in rows) == [("bark/VERB", "VERB"), ("dog/obl", "> chi_obl")]
    assert graph.dangling(tokens).count() == 1
    assert graph.with_sentences(graph.targets(tokens, "cat"), tokens).first().sentence == "Cat Bark At Dog Bark"


def test_templates():
    t = relation_template("> (chi_nsubj, [NOUN, PROPN]) > (pa_x, []) & > (chi_obj, [])")
    assert t.paths == ((Step("chi_nsubj", ("NOUN", "PROPN")), Step("pa_x", None)), (Step("chi_obj", None),))
    assert construction_template("(VERB) & > (chi_nsubj, [])").anchor == "VERB"
    assert slot_columns("[a][b > c][d | e > f]") == [("a", [["a"]]), ("b > c", [["b", "c"]]), ("d | e > f", [["d"], ["e", "f"]])]
    for bad, parse in [("(chi_obj)", relation_template), ("", relation_template), ("> (a, []) &", relation_template), ("> chi", relation_template), ("(VERB)", construction_template), ("> (a, [])", construction_template), ("a[b]", slot_columns), ("[]", slot_columns)]:
        with pytest.raises(ValueError):
            parse(bad)


def test_observations(tokens, spark):
    combos = observe.path_combos(tokens, "bark", "VERB", 1)
    assert {(r.period, tuple(r.slots)): r.frequency for r in combos.collect()} == {("p1", ("> chi_advmod", "> chi_nsubj")): 2, ("p2", ()): 1, ("p2", ("> chi_nsubj", "> chi_obl")): 1}
    cut = observe.path_combos(tokens, "bark", "VERB", 1, ["chi_obl", "chi_advmod"])
    assert {(r.period, tuple(r.slots)): r.frequency for r in cut.collect()} == {("p1", ("> chi_nsubj",)): 2, ("p2", ("> chi_nsubj",)): 1}
    deep = spark.createDataFrame([("p", "t", ["> a > b", "> a > c"], 2), ("p", "t", ["> a"], 3), ("p", "t", ["> x > y"], 1)], "period string, target string, slots array<string>, frequency long")
    assert {tuple(r.slots): r.frequency for r in observe.trim_and_merge(deep, ["b", "c", "x"]).collect()} == {("> a",): 5}
    groups = {tuple(r.slot_combs): (r.group_id, r.frequency, len(r.specialisations)) for r in observe.specialisations(deep).collect()}
    assert groups == {("a",): (1, 5, 2), ("x",): (2, 1, 1)}
    assert {r.item: r.weight for r in observe.construction_rows(deep).collect()} == {"> a > b & > a > c": 2, "> a": 3, "> x > y": 1}
    with pytest.raises(Exception, match="whole numbers"):
        observe.construction_rows(deep.withColumn("frequency", -F.col("frequency"))).collect()
    fill = observe.slot_fillers(tokens, "[chi_nsubj][chi_advmod > chi_advmod | chi_obl]", "bark", "VERB", filtered_pos=["PART"])
    got = sorted((r.slot, tuple(r.item)) for r in fill.collect())
    assert got == [("chi_advmod > chi_advmod | chi_obl", ("dog",)), ("chi_advmod > chi_advmod | chi_obl", ("loud", "very")), ("chi_nsubj", ("cat",)), ("chi_nsubj", ("dog",)), ("chi_nsubj", ("dog",))]
    back = observe.long(observe.wide(fill))
    assert sorted((r.id, r.slot, tuple(r.item)) for r in back.collect()) == sorted((r.id, r.slot, tuple(r.item)) for r in fill.collect())
    merged, missing = observe.merge_slots(fill, {"any": ["chi_nsubj", "gone"]})
    assert missing == ["gone"] and {r.slot for r in merged.collect()} == {"any", "chi_advmod > chi_advmod | chi_obl"}


def test_features(tokens):
    assert {(r.period, r.slot): r["count"] for r in observe.feature_counts(tokens, "bark", "VERB").collect()} == {("p1", "Mood"): 1, ("p1", "Tense"): 1, ("p1", "A"): 2}
    assert sorted((r.slot, r.item) for r in observe.features(tokens).collect()) == [("A", "x"), ("A", "y"), ("Mood", "Ind"), ("Number", "Sing"), ("Tense", "Pres")]
    assert observe.feature_counts(tokens, "not").first()["count"] == 1  # a type with an empty value counts, its value does not


def test_contexts_and_lines(tokens):
    got = [r.context for r in observe.contexts(tokens, graph.targets(tokens, "very")).collect()]
    assert got == ["Dog Not Bark Loud <TAR> Very <TAR>"]
    lines = {r.sent_seq: r.line for r in observe.sentence_lines(tokens.withColumn("pos", F.when(F.col("pos") == "ADP", "PUNCT").otherwise(F.col("pos")))).collect()}
    assert lines[3] == "cat bark dog bark"


def test_merge_formulas_and_required_columns(tokens):
    want = {"new": ["a", "b"], "other": ["c"]}
    assert observe.formula_of(want) == want
    assert observe.formula_of([("new", ["a", "b"]), ("other", "c")]) == want
    assert observe.formula_of([{"output": "new", "columns": ["a", "b"]}, {"target": "other", "sources": "c"}]) == want
    with pytest.raises(ValueError):
        observe.formula_of([{"output": "new"}])
    with pytest.raises(ValueError):
        observe.specialisations(tokens)


def test_searches_move_no_tokens(tokens, spark):
    """Packed sentences, ids being text or whole numbers, give what tokens give, and only results are shuffled."""
    fields = ("form", "lemma", "pos", "id", "head", "deprel")
    whole = tokens.groupBy("period", "file", "sent_seq").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("k"), *fields))).alias("t"))
    sentences = whole.select("period", "file", "sent_seq", *[F.col(f"t.{c}").alias(c) for c in fields])
    numbers = sentences.withColumn("id", F.col("id").cast("array<int>")).withColumn("head", F.col("head").cast("array<int>")).localCheckpoint()
    template = relation_template("> (chi_nsubj, []) & > (chi_advmod, [])")
    chains = construction_template("(VERB) & > (chi_obl, []) > (chi_case, [ADP])")
    for make in (
        lambda t: graph.relation_search(t, template, "bark", mode="close", fmt="token/deprel"),
        lambda t: graph.construction_search(t, chains, fmt="lemma/deprel"),
        lambda t: observe.path_counts(t, "bark", "VERB"),
        lambda t: observe.path_combos(t, "bark", "VERB").withColumn("slots", F.array_join("slots", "&")),
        lambda t: observe.slot_fillers(t, "[chi_nsubj][chi_advmod > chi_advmod | chi_obl]", "bark", filtered_pos=["PART"], fmt="lemma/pos").withColumn("item", F.array_join("item", "|")),
    ):
        want = sorted(map(str, make(tokens).collect()))
        assert want and sorted(map(str, make(sentences).collect())) == want and sorted(map(str, make(numbers).collect())) == want
    plan = lambda f: f._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Join" not in plan(graph.relation_search(tokens, template, "bark", mode="close")) and plan(graph.relation_search(tokens, template, "bark", mode="close")).count("Exchange hashpartitioning") == 1
    assert "Exchange" not in plan(graph.relation_search(numbers, template, "bark", mode="close"))


def test_merging_slots_is_one_pass(spark):
    obs = spark.createDataFrame([("1", "p", "a", "x"), ("1", "p", "b", "x"), ("1", "p", "c", "y"), ("1", "p", "c", "y"), ("2", "p", None, "z")], "id string, period string, slot string, item string")
    formula = {"new": ["a", "b", "gone"], "other": "a"}
    rows = lambda f: sorted((r.id, str(r.slot), r.item) for r in f.collect())
    rest = [("1", "c", "y"), ("1", "c", "y"), ("2", "None", "z")]
    assert rows(observe.merged_slots(obs, formula)) == sorted([("1", "new", "x"), ("1", "new", "x"), ("1", "other", "x"), *rest])
    assert rows(observe.merged_slots(obs, formula, dedupe=True)) == sorted([("1", "new", "x"), ("1", "other", "x"), *rest])
    assert rows(observe.merged_slots(obs, formula, dedupe=True, keep_sources=True)) == sorted([("1", "a", "x"), ("1", "b", "x"), ("1", "new", "x"), ("1", "other", "x"), *rest])
    plan = observe.merged_slots(obs, formula, dedupe=True)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Scan") == 1 and "Join" not in plan and observe.missing_slots(obs, formula) == ["gone"]

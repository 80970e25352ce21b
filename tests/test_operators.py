"""Literal fixtures for nulls, ties and refusals of the core operators."""

from __future__ import annotations

import math
import re
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.functions import costs as C
from tallyloom.functions import probability as P
from tallyloom.functions import text as T
from tallyloom.operators import basket as B
from tallyloom.operators import catalogue as K
from tallyloom.operators import games as G
from tallyloom.operators import maintain as M
from tallyloom.operators import relational as R
from tallyloom.operators import resolve as N
from tallyloom.plans import sqlgate as Q
from tallyloom.sources import readers as S
from tallyloom.streaming import jobs as J


def baskets(spark):
    data = [
        (1, "Std", "mtgo", "MTGO L", "2026-01-05"),
        (2, "Std", "mtgtop8", "MTGO L", "2026-01-04"),
        (3, "Std", "mtgtop8", "MTGO L", "2026-01-05"),
        (4, "Std", "mtgtop8", None, "2026-01-09"),
        (5, "Std", "mtgtop8", "MTGO L", None),
        (6, "Old", "mtgtop8", "MTGO L", "2026-01-09"),
        (7, "Std", "other", "X", "2025-01-01"),
    ]
    return spark.createDataFrame(data, "basket int, format string, source string, event string, d string").withColumn("day", F.to_date("d")).drop("d")


def test_source_coverage_nulls(spark):
    b = baskets(spark)
    keep = {r[0] for r in B.source_coverage(b, "mtgo", "mtgtop8", "MTGO ").select("basket").collect()}
    drop = {r[0] for r in B.source_coverage(b, "mtgo", "mtgtop8", "MTGO ", keep_unknown=False).select("basket").collect()}
    # mtgtop8 itself begins with "mtgo"? It does not, so only basket 1 is official.
    assert keep == {1, 2, 4, 5, 6, 7}
    assert drop == {1, 2, 7}


def test_signature_and_windows(spark):
    b = baskets(spark)
    lines = spark.createDataFrame(
        [(1, "main", 10, "a", 2), (1, "main", 10, "a", 2), (2, "main", 10, "a", 4), (3, "main", 10, "a", 4), (3, "side", None, "zzz", 1), (4, "main", 10, "a", 0), (7, "main", 10, "a", 4)], "basket int, board string, item int, raw_name string, n int"
    )
    summed = B.basket_lines(lines)
    sig = {r["basket"]: (r["sig"], r["has_unresolved"]) for r in B.basket_signatures(summed).collect()}
    assert sig[1][0] == sig[2][0] and sig[3][0] != sig[2][0] and sig[3][1] and 4 not in sig
    plain = {r["basket"]: r["sig"] for r in B.plain_signatures(summed).collect()}
    assert plain[1] == plain[3] == plain[4]
    pops = spark.createDataFrame([(1, "Std", "recent_90d", 1, True, False), (2, "Std", "all", 2, False, True), (3, "None", "all", 1, False, False)], "population_id int, format string, window_code string, floor int, has_side boolean, merge_extra boolean")
    w = B.population_windows(pops, b, date(2026, 2, 1))
    assert {r["population_id"]: r["window_end"] for r in w.collect()} == {1: date(2026, 2, 1), 2: date(2026, 2, 1), 3: None}
    raw = B.windowed_baskets(w, b, B.basket_signatures(summed))
    reps = {(r["population_id"], r["basket"]) for r in B.representatives(raw).collect()}
    # The window comes first: 7 is the same list as 1 but outside the recent one.
    assert reps == {(1, 1), (1, 3), (2, 1), (2, 3)}


def test_consistency_gate(spark):
    reps = spark.createDataFrame([(p, i) for p in (1, 2, 3) for i in range(5)], "population_id int, basket int")
    counts = spark.createDataFrame([(1, 10, 4, 1), (1, 20, 3, 1), (2, 10, 4, None), (2, 20, 4, None), (3, 10, 6, 0)], "population_id int, item int, main_count int, side_count int")
    pairs = spark.createDataFrame([(1, "m", 10, 20, 2), (1, "s", 10, 20, 1), (2, "m", 10, 20, 1), (2, "m", 10, 30, 1), (3, "m", 10, 20, 1)], "population_id int, relation string, item_a int, item_b int, n int")
    got = {r["population_id"]: (r["bad_counts"], r["orphan_pairs"], r["bad_pairs"]) for r in B.consistency(reps, counts, pairs).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 1, 1), 3: (1, 1, 0)}
    assert rows(B.publishable(B.consistency(reps, counts, pairs))) == [(1,)]


def test_diff(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "c", None), (9, "z", 2)], "k int, v string, s int")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (4, "d", 1)], "k int, v string, s int")
    got = {r["k"]: r["action"] for r in M.diff_actions(old, new, ["k"], ["v", "s"]).collect()}
    assert got == {1: "same", 2: "update", 3: "delete", 4: "insert", 9: "delete"}
    scoped = M.diff_apply(old, new, ["k"], ["v", "s"], F.col("s") == 1)
    assert rows(scoped) == sorted([(1, "a", 1), (2, "b", 1), (3, "c", None), (4, "d", 1), (9, "z", 2)], key=repr)
    assert M.verify_equal(M.diff_apply(old, new, ["k"], ["v", "s"]), new).first()["ok"]
    assert not M.verify_equal(new, new.union(new.limit(1))).first()["ok"]
    with pytest.raises(Exception, match="fewer than 10"):
        M.row_count_gate(new, 10, "cards").collect()


def test_probability_goldens(spark):
    cases = [(n, k, d, m) for n, k, d in ((60, 4, 7), (60, 0, 7), (60, 24, 60), (40, 17, 10), (500, 250, 100), (0, 0, 0), (10, 11, 2), (10, 2, 11), (10, -1, 2)) for m in (-1, 0, 1, 2, 8)]
    df = spark.createDataFrame(cases, "n int, k int, d int, m int")
    c = [F.col(x) for x in "nkdm"]
    for r in df.select("*", P.hypergeom_exact(*c).alias("e"), P.hypergeom_atleast(*c).alias("a")).collect():
        n, k, d, m = r[:4]
        if n <= 0 or not 0 <= d <= n or not 0 <= k <= n:
            assert r["e"] is None and r["a"] is None
            continue
        at = lambda i: math.comb(k, i) * math.comb(n - k, d - i) / math.comb(n, d) if 0 <= i <= min(k, d) and d - i <= n - k else 0
        assert r["e"] == pytest.approx(at(m), abs=1e-6)
        assert r["a"] == pytest.approx(1 if m <= 0 else sum(at(i) for i in range(m, min(k, d) + 1)), abs=1e-6)


def brute_castable(counts, pay, need, mana, deck, d, turn):
    """Assigns sources to costs one by one over all draws."""
    import itertools

    total = 0
    for x in itertools.product(*[range(c + 1) for c in counts]):
        other = d - sum(x)
        if other < 0 or other > deck - sum(counts):
            continue
        ways = math.comb(deck - sum(counts), other)
        for c, v in zip(counts, x):
            ways *= math.comb(c, v)
        sources = [p for p, v in zip(pay, x) for _ in range(v)]
        ok = False
        for costs, m in zip(need, mana):
            if min(sum(x), turn) < m:
                continue
            pips = [t for t, n in enumerate(costs) for _ in range(n)]
            ok |= any(all(sources[s] >> t & 1 for s, t in zip(pick, pips)) for pick in itertools.permutations(range(len(sources)), len(pips)))
        total += ways * ok
    return total / math.comb(deck, d)


@pytest.mark.parametrize("case", [(12, [3, 2], [1, 2], [[1, 1]], [2], 2), (10, [2, 2, 1], [1, 2, 3], [[1, 1], [2, 0]], [2, 3], 3), (8, [], [], [[0, 0]], [0], 1), (9, [4], [3], [[1, 2]], [3], 3)])
def test_castable_against_assignment(case):
    deck, counts, pay, need, mana, turn = case
    d = min(7 + turn - 1, deck)
    assert P.castable_value(deck, counts, pay, need, mana, turn, True, 0) == pytest.approx(brute_castable(counts, pay, need, mana, deck, d, turn), abs=1e-6)


def test_castable_refusals(spark):
    assert P.castable_value(60, [10], [4], [[1, 1]], [1], 2, True, 0) is None
    assert P.castable_value(60, [10, None], [1, 1], [[1]], [1], 2, True, 0) is None
    assert P.castable_value(60, [30, 30, 30], [1, 1, 1], [[1]], [1], 2, True, 0) is None
    assert P.hand_value(60, [24], [3], [2], 0, True, 0) is None
    assert P.hand_value(60, [24], [2], [5], 0, True, 0) == pytest.approx(sum(math.comb(24, i) * math.comb(36, 7 - i) for i in range(2, 6)) / math.comb(60, 7), abs=1e-6)
    assert P.castable_value(60, [0] * 8, [1] * 8, [[1]], [1], 3, True, 0) == 0.0
    with pytest.raises(ValueError):
        P.grid(spark, {"a": [1, 1]})
    with pytest.raises(ValueError):
        P.grid(spark, {"a": list(range(10)), "b": list(range(10))})
    assert [tuple(r) for r in P.grid(spark, {"a": [2, 1, 2], "b": [5, 6]}).orderBy("row_no").collect()] == [(0, 2, 5), (1, 2, 6), (2, 1, 5), (3, 1, 6)]
    names = P.register_sql(spark)
    assert len(names) == 10 and all(n.startswith("mtg_") for n in names)
    assert spark.sql("SELECT mtg_comb(60, 7), mtg_comb(5, 9), mtg_cards_seen(3, true, 0), mtg_cards_seen(3, false), mtg_hypergeom_atleast(60, 4, 7, NULL)").first()[:] == (float(math.comb(60, 7)), 0.0, 9, 10, None)
    assert spark.sql("SELECT mtg_int_array_ok(NULL, 1), mtg_castable(60, array(10), array(4), array(array(1, 1)), array(1), 2, true, 0), mtg_prob_by_turn(60, 4, 1, true) = mtg_hypergeom_atleast(60, 4, 7, 1)").first()[:] == (False, None, True)


def test_answers_tell_bad_input_from_undefined(spark):
    calls = [("at_least", 60, 4, 0, 7, 1, True, 1, 0), ("combo_by_turn", 10, 6, 6, 0, 1, True, 1, 0), ("odds", 60, 4, 0, 7, 1, True, 1, 0), ("by_turn", 60, 4, 0, 7, 0, True, 1, 0), ("by_turn", 60, 61, 0, 7, 1, True, 1, 0), ("by_turn", None, 4, 0, 7, 1, True, 1, 0), (None, 60, 4, 0, 7, 1, True, 1, 0)]
    df = spark.createDataFrame(calls, "kind string, deck_size int, copies int, copies_b int, draws int, turn int, on_play boolean, at_least int, mulligans int")
    got = [(r["status"], r["percent"]) for r in P.answer_chances(df).collect()]
    assert got == [(P.OK, "40.0%"), (P.UNDEFINED, None), (P.UNKNOWN_KIND, None), (P.OUT_OF_RANGE, None), (P.OUT_OF_RANGE, None), (P.OUT_OF_RANGE, None), (P.UNKNOWN_KIND, None)]


def test_text(spark):
    df = spark.createDataFrame([("word", "two words"), ("abc", "abc"), ("", ""), ("a", "b"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(N.similarity_of(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.363636, abs=1e-6) and got[1] == 1 and got[2] == 0 and got[3] == 0
    assert [T.stem(w) for w in ("running", "hopping", "relational", "ponies", "caresses", "agreed", "happy", "sky", "adoption", "controlling")] == ["run", "hop", "relat", "poni", "caress", "agre", "happi", "sky", "adopt", "control"]
    r = spark.createDataFrame([("Ａ＆Ｂ", "a &amp; b")], "x string, y string").select(T.name_form(F.col("x")), T.html_unescape(F.col("y")), T.sequence_ratio(F.col("x"), F.col("x"))).first()
    assert tuple(r) == ("a&b", "a & b", 1.0)


def test_near_in_list(spark):
    entries = spark.createDataFrame([("S", "Lightning Bolt", ["Lightning Bolt", "稲妻の一撃", None]), ("S", "Hearth Elemental", ["Hearth Elemental"]), ("S", "Ring", ["Ring"]), ("T", "Lightning Bolt", ["Lightning Bolt"])], "g string, k string, names array<string>")
    asked = ["Lightning", "the", "Old Lightning Bolt Foil", "", "Bolt, Lightning!", "LIGHTNING-BOLT", "Ｒｉｎｇ", "ring", "Rin", "稲妻の一撃!", "稲妻", "火 稲妻の", "Lightnng Bolt", None]
    q = spark.createDataFrame([("S", a, 1) for a in asked], "g string, a string, k int")
    score = {(r["query"], r["key"]): r["score"] for r in N.near_in_list(q, "a", entries, "g", "names", "k", 5, 0.5).collect()}
    bolt = {a: s for (a, k), s in score.items() if k == "Lightning Bolt"}
    assert [bolt.get(a) for a in ("Lightning", "Old Lightning Bolt Foil", "LIGHTNING-BOLT", "稲妻の一撃!", "稲妻")] == [0.9, 0.85, 1.0, 1.0, 0.6]
    assert bolt["Bolt, Lightning!"] == 0.8 and bolt["Lightnng Bolt"] > 0.9 and "" not in bolt
    assert score["Ｒｉｎｇ", "Ring"] == score["ring", "Ring"] == 1.0 and ("the", "Hearth Elemental") not in score and ("Rin", "Ring") not in score
    plain = {(r["query"], r["key"]): r["score"] for r in N.near_in_list(q, "a", entries, "g", "names", "k", 5, 0.5, fuzzy=False).collect()}
    assert all(score[k] >= v for k, v in plain.items()) and ("Lightnng Bolt", "Lightning Bolt") not in {k for k, v in plain.items() if v > 0.8}
    ties = N.near_in_list(q.where("a = 'Lightning'"), "a", entries.union(spark.createDataFrame([("S", "Lightning X", ["Lightning X"])], entries.schema)), "g", "names", "k", 1).first()
    assert (ties["key"], ties["ties_left"]) == ("Lightning Bolt", 1)
    assert rows(N.near_in_list(q, "a", entries.limit(0), "g", "names", "k")) == []


def test_near_names_by_rare_trigrams(spark):
    words = ["kestrel", "kestral", "of the lake", "lake", "of the moon", "moon", "", "x", "kes", None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    grams = lambda t: {("  " + x + " ")[i : i + 3] for x in re.findall("[a-z]+", t) for i in range(len(x) + 1)}
    want = set()
    for a in words:
        for i, b in enumerate(words):
            if a and b and (s := len(grams(a) & grams(b)) / len(grams(a) | grams(b))) > 0.3:
                want.add((a, i, round(s, 6)))
    got = {(r["query"], r["key"], r["similarity"]) for r in N.near_names(df, "w", df, "w", "i", 100).collect()}
    assert got == want
    assert rows(N.near_names(df, "w", df.limit(0), "w", "i")) == []


def test_resolution(spark):
    cards = spark.createDataFrame(
        [(1, "Fire // Ice", "Fire", "Ice", False), (2, "Ice", "Ice", None, False), (3, "Wall", "Wall", None, True), (4, "Wall Two // Moss", "Wall Two", "Moss", False), (5, "Peat // Moss", "Peat", "Moss", False), (6, "wall", "wall", None, False)],
        "id int, card_name string, name_en_front string, name_en_back string, digital boolean",
    )
    q = spark.createDataFrame([("Ice",), ("Fire / Ice",), ("Moss",), ("fire",), ("Wall",), ("WALL",), ("none",), (" ",), (None,)], "q string")
    got = {r["query"]: (r["status"], r["id"]) for r in N.resolve(q, "q", N.name_table(cards)).collect()}
    assert got == {"Ice": ("resolved", 2), "Fire / Ice": ("resolved", 1), "Moss": ("ambiguous", None), "fire": ("resolved", 1), "Wall": ("resolved", 3), "WALL": ("resolved", 6), "none": ("unknown", None)}
    assert N.close_key("modren", ["modern", "legacy"]) == ("modern", "corrected") and N.close_key("xx", ["modern"]) == (None, "unknown")
    v = spark.createDataFrame([("B? Staff",), ("fire",), ("A-Ice",), ("zz",)], "v string")
    cards2 = cards.select("card_name").union(spark.createDataFrame([("Bō Staff",)], "c string"))
    assert {r["value"]: (r["db_name"], r["match_kind"]) for r in N.match_names(v, "v", cards2).collect()} == {"B? Staff": ("Bō Staff", "mojibake"), "fire": ("Fire // Ice", "front"), "A-Ice": ("Ice", "exact"), "zz": (None, "none")}


def test_games(spark):
    g = spark.createDataFrame([("True", 1.0, None, 1.0, None), ("false", None, 2.0, 1.0, 1.0), ("TRUE", 1.0, 1.0, None, None), (None, None, None, None, None)], "won string, opening_hand_a float, drawn_a float, deck_a float, deck_b float").withColumn("opening_hand_b", F.lit(None).cast("float")).withColumn("drawn_b", F.lit(None).cast("float"))
    got = {r["item"]: r.asDict() for r in G.game_stats(g).collect()}
    a = got["a"]
    assert (a["gih_games"], a["gih_wins"], a["oh_games"], a["gd_games"], a["gd_wins"], a["gp_games"]) == (3, 2, 2, 1, 0, 2)
    assert got["b"]["gih_wr"] is None and got["b"]["gp_wins"] == 0
    # The same four rows give two packs and a mean of 1.5 however they are split.
    p = spark.createDataFrame([("d", 1, 0, "a", 1.0), ("d", 1, 1, "zz", 1.0), ("d", 2, 0, "a", 1.0), ("d", 2, 1, None, None)], "draft_id string, pack_number int, pick_number int, pick string, pack_card_a float")
    for n in (1, 2, 4):
        r = G.seen_and_taken(p.repartition(n), "draft_id", "pack_number", "pick_number", "pick").first()
        assert (r["seen_packs"], r["alsa"], r["taken_count"], r["ata"]) == (2, 1.5, 2, 1.0)
    assert rows(G.unknown_picks(p, "pick")) == [("zz", 1)]
    stats = spark.createDataFrame([("a", "S", 1, 0.5), ("a", "S", 2, 0.6)], "card_name string, expansion string, gih_games int, gih_wr double")
    with pytest.raises(Exception, match="duplicate"):
        G.attach_stats(stats.select("card_name").distinct(), stats, "card_name", "expansion", ["S"]).collect()


def test_costs(spark):
    df = spark.createDataFrame([("{2}{W/U}",), ("{X}{B/P}{2/G}",), ("{G/W/P}{12}",), ("",), (None,), ("{W}x",), ("{W/W}",), ("{Q}",)], "c string")
    c = F.col("c")
    got = [tuple(r) for r in df.select(C.cost_value(c), C.payable(c, F.array(F.lit("U"))), C.payable(c, F.lit(None).cast("array<string>")), F.array_join(C.either_needed(c), ",")).collect()]
    assert [g[0] for g in got] == [3, 3, 13, 0, 0, None, None, None]
    assert [g[1] for g in got] == ["true", "true", "true", "true", "true", "unknown", "unknown", "unknown"]
    assert got[0][2] == "not_judged" and got[0][3] == "W/U"


def test_ways_to_pay(spark):
    df = spark.createDataFrame([("{1}{W/U}{2/G}{X}",), ("{3}",), ("{B/P}{W}{W}",), ("",), ("{W}x",), ("{Q}",), (None,), ("{2/G}{2/G}{2/R}",)], "c string").withColumn("p", C.cost_plan(F.col("c"))).withColumn("w", C.ways_to_pay(F.col("p")))
    got = [(r["p"]["error"], list(r["w"]["types"] or []), [(list(x["need"]), x["mana"]) for x in r["w"]["ways"] or []], list(r["p"]["notes"] or [])) if r["p"]["error"] is None else r["p"]["error"] for r in df.collect()]
    assert got[0] == (None, [3, 16], [([1, 1], 3), ([1, 0], 4)], ["X counts as 0"])
    assert got[1] == (None, [], [([0], 3)], []) and got[2] == (None, [1], [([2], 2)], ["{B/P} is paid with life"])
    assert got[3:7] == ["no symbol", "text outside of symbols", "unknown symbol", "no symbol"] and len(got[7][2]) == 8 and got[7][2][0] == ([1, 2], 3) and got[7][2][7] == ([0, 0], 6)
    lands = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(n).alias("count")) for m, n in ((1, 3), (3, 2), (16, 4), (32, 5), (2, 0))])
    k = df.limit(2).select(C.source_classes(lands, F.col("w.types")).alias("k")).collect()
    assert [tuple(x) for x in k[0]["k"]] == [(0, 5), (1, 5), (2, 4)] and [tuple(x) for x in k[1]["k"]] == [(0, 14)]
    assert P.castable_value(20, [5, 5, 4], [0, 1, 2], [[1, 1], [1, 0]], [3, 4], 4, True, 0) == pytest.approx(brute_castable([5, 5, 4], [0, 1, 2], [[1, 1], [1, 0]], [3, 4], 20, 10, 4), abs=1e-6)


def test_codes_reject_every_change(spark):
    g = spark.createDataFrame([(1, "ABC", ["Alpha", "Beta x"])], "id int, scope string, names array<string>")
    code = K.encode_codes(g, "SD1", "scope", F.col("names")).first()["code"]
    changed = [code[:i] + ch + code[i + 1 :] for i in range(len(code)) for ch in "|aZ0 " if ch != code[i]] + [code[:-1], code + "|", "", code + "x"]
    states = K.decode_codes(spark.createDataFrame([(c,) for c in [code, *changed]] + [(None,)], "code string"), "code").select("code", "state").collect()
    assert states[0]["state"] == "ok" and all(r["state"] != "ok" for r in states[1:])


def test_sql_gate(spark):
    assert Q.tags("-- hello #ONE\n/* #TWO */ SELECT 1") == ["ONE", "TWO"]
    for bad, kind in (("SELECT 1; SELECT 2", "several statements"), ("DROP TABLE x", "not a query"), ("  -- only\n", "empty"), ("SELECT ';'", "several statements")):
        with pytest.raises(Q.Refused) as e:
            Q.admitted(bad)
        assert e.value.kind == kind
    assert Q.run_sql(spark, "-- x\nSELECT id FROM range(100);", 1000).count() == 50
    with pytest.raises(Exception, match="larger than"):
        Q.guard_rows(spark.range(1).select(F.repeat(F.lit("x"), 400_000).alias("t")), 5).collect()
    with pytest.raises(Exception, match="larger than"):
        Q.guard_rows(spark.range(1).select(F.repeat(F.lit("x"), 400_000).alias("t"), F.lit(1).alias("t")), 5).collect()
    spark.range(3).createOrReplaceTempView("three")
    for bad in ("SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT id, java_method('java.lang.Math', 'abs', -1) FROM three", "SELECT * FROM parquet.`/tmp/x`", "WITH t AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM t", "SELECT (SELECT max(try_reflect('java.lang.System', 'lineSeparator')) FROM three)", "SELECT TRANSFORM(id) USING 'cat' FROM three", "SELECT id FROM three WHERE id IN (SELECT count(*) FROM json.`/x`)", "SELECT input_file_name() FROM three"):
        with pytest.raises(Q.Refused):
            Q.run_sql(spark, bad)
    for good in ("WITH t AS (SELECT id, 'reflect(1)' AS x FROM three) SELECT a.id, sum(a.id) OVER (ORDER BY a.id) s FROM t a JOIN t b ON a.id = b.id WHERE a.id IN (SELECT id FROM three) AND EXISTS (SELECT 1 FROM three) ORDER BY 1", "SELECT id % 2, count(*), collect_list(id) FROM three GROUP BY 1 HAVING count(*) > 0 UNION ALL SELECT 1, 1, array(1)", "SELECT * FROM three PIVOT (count(*) FOR id IN (1, 2))", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT * FROM r", "SELECT id, e FROM three LATERAL VIEW explode(array(1, 2)) x AS e", "SELECT x.n FROM three, LATERAL (SELECT id + 1 AS n) x", "SELECT * FROM VALUES (1), (2) v(a) EXCEPT SELECT 1", "SELECT id FROM three LIMIT 2 OFFSET 1", "SELECT DISTINCT id, (SELECT max(id) FROM three) FROM three TABLESAMPLE (50 PERCENT)"):
        Q.run_sql(spark, good).collect()
    assert Q.render(spark.createDataFrame([(None, "y" * 500)], "a int, b string"))[1].startswith("NULL | y") and len(Q.render(spark.createDataFrame([(None, "y" * 500)], "a int, b string"))[1]) < 200


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert S.json_array(spark, str(tmp_path / "a.json"), "a int").count() == 2
    (tmp_path / "l.json").write_text('junk\n{"a": 1},\n{"a": 2}\n[\n')
    assert rows(S.json_lines(spark, str(tmp_path / "l.json"), "a int")) == [(1,), (2,)]
    (tmp_path / "decks").mkdir()
    (tmp_path / "decks" / "d.json").write_text('{"data": {"name": "D", "mainBoard": [{"name": "x", "count": 4}], "sideBoard": [], "commander": null}}')
    assert [tuple(r)[1:] for r in S.deck_documents(spark, str(tmp_path / "decks")).collect()] == [("D", "main", "x", 4)]
    (tmp_path / "decks" / "bad.json").write_text('{"data": {"name": ')
    (tmp_path / "decks" / "none.json").write_text('{"x": 1}')
    assert sorted(r[0].rsplit("/", 1)[-1] for r in S.unreadable_documents(spark, str(tmp_path / "decks")).collect()) == ["bad.json", "none.json"]
    (tmp_path / "w.csv").write_text("won,deck_a,opening_hand_a,drawn_a\nTrue,1,,2\nFalse,NA,1,0\n")
    assert {r["item"]: (r["gp_games"], r["oh_games"]) for r in G.game_stats(S.wide_csv(spark, str(tmp_path / "w.csv"))).collect()} == {"a": (1, 1)}
    t = spark.createDataFrame([("// NAME x\n4 [ABC] Fire\nSB: 2 Ice\nbad\n",), (None,)], "t string").withColumn("k", F.lit(1))
    assert [tuple(r)[2:] for r in S.deck_text(t, "k", "t").collect()] == [("main", 4, "Fire"), ("side", 2, "Ice")]
    r = spark.createDataFrame([(1, "702.1. First rule\ngoes on\n702.1a Child\n\nText")], "k int, t string")
    assert rows(S.rulebook(r, "k", "t")) == [(1, "702.1", "First rule goes on"), (1, "702.1a", "Child Text")]
    assert rows(S.glossary(spark.createDataFrame([(1, "Term\nline one\nline two\n\nOther\nx")], "k int, t string"), "k", "t")) == [(1, "Other", "x"), (1, "Term", "line one line two")]
    assert str(spark.createDataFrame([("on 05/01/26",)], "t string").select(S.short_date(F.col("t"))).first()[0]) == "2026-01-05"
    log = spark.createDataFrame([("2026-01-01 00:00:00\tissue\tk\tip\t60\tm",), ("2026-01-02 00:00:00\tstop\tk\tip\t60\tm",), ("x\tissue\tk\tip\t60\tm",), ("short",)], "value string")
    assert rows(S.latest_state(S.event_log(log)).select("key", "alive")) == [("k", False)]
    a, b = S.call_log(spark.createDataFrame([("2026-01-01 00:00:00\ttool\t{}\tk",), ("2026-01-01 00:00:01\tend\ttool\tok\t0.5\t1\t0.1\tk",), ("x",)], "value string"))
    assert a.count() == 1 and b.first()["seconds"] == 0.5


def test_windows_and_ties(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "c", 5), (1, "d", 7), (2, "e", 1)], "g int, k string, s int")
    got = rows(R.top_k_with_ties_left(df, ["g"], F.col("s").desc(), "k", 2).select("g", "k", "ties_left"))
    assert got == [(1, "a", 2), (1, "d", 2), (2, "e", 0)]
    e = spark.createDataFrame([("u", "2026-01-01 00:00:00"), ("u", "2026-01-01 00:00:30"), ("u", "2026-01-01 00:01:00")], "u string, t string").selectExpr("u", "cast(t as timestamp) t")
    assert [r["n_window"] for r in R.sliding_count(e, "u", "t", 60).orderBy("t").collect()] == [1, 2, 2]


def test_rate_limit(spark, tmp_path):
    assert J.admit([0, 1, 2, 10, 11], [], 2, 10) == ([True, True, False, True, True], [10, 11], [None, None, 8, None, None])
    e = spark.createDataFrame([("u", f"2026-01-01 00:00:{s:02d}") for s in (0, 1, 2, 10, 11)] + [("v", "2026-01-01 00:00:05")], "u string, t string").selectExpr("u", "cast(t as timestamp) ts")
    got = [r["admitted"] for r in J.rate_limit_batch(e, "u", "ts", 2, 10).where("key = 'u'").orderBy("us").collect()]
    assert got == [True, True, False, True, True]
    both = {(r["key"], r["us"] // 1_000_000 % 60): (r["admitted"], r["refused_by"]) for r in J.rate_limit_total(e.withColumn("us", F.unix_micros("ts")).withColumnRenamed("us", "us2").withColumn("us", F.col("us2")), "u", "ts", 2, 2, 10).collect()}
    assert both == {("u", 0): (True, None), ("u", 1): (True, None), ("u", 2): (False, "key"), ("v", 5): (False, "total"), ("u", 10): (True, None), ("u", 11): (True, None)}
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = J.read_stream(spark, str(tmp_path / "in"), e.schema)
    out = J.run_once(J.rate_limit(stream, "u", "ts", 2, 10), "limited_calls", "append", str(tmp_path / "cp"))
    assert [r["admitted"] for r in out.where("key = 'u'").orderBy("ts").collect()] == [True, True, False, True, True]
    s = J.run_once(J.sessions(J.read_stream(spark, str(tmp_path / "in"), e.schema), "u", "ts", "5 seconds"), "sess", "complete", str(tmp_path / "cp2"))
    assert sorted(r["n"] for r in s.collect()) == [1, 2, 3]


def test_foreach_batch_upsert(spark, tmp_path):
    state = {"t": spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")}

    def write(df):
        state["t"] = spark.createDataFrame(df.collect(), "k int, v string")

    run = J.apply_changes(lambda: state["t"], write, ["k"], ["v"])
    batch = spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string")
    run(batch, 0)
    run(batch, 0)
    assert rows(state["t"]) == [(1, "a"), (2, "x"), (3, "c")]


def test_all_rulings_are_read(spark, tmp_path):
    from tallyloom.plans import registered

    spark.createDataFrame([(1, "two  blanks"), (2, None), (3, "plain")], "id int, comment string").write.parquet(f"{tmp_path}/card_rulings.parquet")
    assert rows(registered()[0]["s07_rulebook"](spark, str(tmp_path))) == [(1, "12.1a", "two  blanks and so on"), (3, "12.3a", "plain and so on")]


def test_changes_of_one_key_in_a_batch(spark):
    state = {"t": spark.createDataFrame([(1, "a")], "k int, v string")}

    def write(df):
        state["t"] = spark.createDataFrame(df.collect(), "k int, v string")

    changes = [(1, "z", 1), (1, None, 3), (1, "y", 2), (2, "b", 5), (2, "c", 5), (2, "x", None), (3, None, 1), (3, "d", 1)]
    for order in (changes, changes[::-1]):
        J.apply_changes(lambda: state["t"], write, ["k"], ["v"], "at")(spark.createDataFrame(order, "k int, v string, at int"), 0)
        assert rows(state["t"]) == [(1, None), (2, "c"), (3, "d")]
    for order in (changes, changes[::-1]):
        J.apply_changes(lambda: state["t"], write, ["k"], ["v"])(spark.createDataFrame(order, "k int, v string, at int"), 0)
        assert rows(state["t"]) == [(1, "z"), (2, "x"), (3, "d")]


def test_rulebook_keeps_long_blocks(spark):
    r = spark.createDataFrame([(1, "1. Start\n" + "\n".join(f"line {i}" for i in range(10_050)) + "\n2. Alone")], "k int, t string")
    assert rows(S.rulebook(r, "k", "t")) == [(1, "1", "Start " + " ".join(f"line {i}" for i in range(10_050))), (1, "2", "Alone")]


def test_first_seen_in_files_out_of_order(spark, tmp_path):
    from tallyloom.plans import registered

    # Newest first in three batches of files, as the watermark drops rows two batches on; event i is in files i and i + 1.
    e = spark.range(250).selectExpr("id AS file", "explode(array(id, id + 1)) AS user_id").selectExpr("user_id", "file", "'x' AS event_type", "timestamp'2025-06-01' - make_interval(0, 0, 0, 0, cast(user_id * 5 AS int)) AS ts")
    e.repartitionByRange(250, "file").drop("file").write.parquet(f"{tmp_path}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) > 200
    assert rows(registered()[0]["st_first_seen"](spark, str(tmp_path))) == sorted([(i, "x") for i in range(251)], key=repr)


def test_sliding_windows_are_no_state(spark, tmp_path):
    """All windows of all users were held as state and then in the driver's memory; rows without a time were lost."""
    from oracle import check, views

    from tallyloom.plans import registered

    # Steps that touch, overlap, lie apart and repeat, over three batches of files of which the last holds the earliest.
    seconds = [None, 0, 9, 10, 59, 60, 60, 61, 200, 255, 256, 1000]
    data = [(i, None if t is None else 5000 - 7 * i - t, None if u == 3 else u) for i in range(3) for u in range(4) for t in seconds]
    e = spark.createDataFrame(data, "file int, t int, user_id int").selectExpr("file", "user_id", "timestamp_seconds(1700000000 + t) AS ts")
    e.repartitionByRange(3, "file").select("user_id", F.expr("cast(ts AS timestamp_ntz)").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    query, sql = registered()[0]["st_sliding"], registered()[1]["st_sliding"]
    assert "MemoryPlan" not in query(spark, str(tmp_path))._jdf.queryExecution().toString()
    check(spark, views(str(tmp_path)), str(tmp_path), query, sql)

    stream = lambda: J.read_stream(spark, f"{tmp_path}/events.parquet", "user_id int, ts timestamp_ntz", 1).withColumn("ts", F.col("ts").cast("timestamp"))
    got = J.sliding_totals(stream(), "user_id", "ts", f"{tmp_path}/sliding")
    assert len(list((tmp_path / "sliding/counts").glob("batch=*"))) == 3 and not (tmp_path / "sliding/stream/state").exists()
    assert rows(got.where("start IS NOT NULL")) == rows(J.run_once(J.sliding_rates(stream(), "user_id", "ts"), "sliding_rates", "complete", f"{tmp_path}/cp"))
    # Begun again over the same folder, it finds nothing new and loses nothing.
    assert rows(J.sliding_totals(stream(), "user_id", "ts", f"{tmp_path}/sliding")) == rows(got)
    with pytest.raises(ValueError):
        J.sliding_totals(stream(), "user_id", "ts", f"{tmp_path}/other", 60, 7)


def test_pick_states_and_combos(spark):
    t = spark.createDataFrame([(1, "has 《Fire/Ice》 and Old Wall here", ), (2, None), (3, "《nope》")], "id int, t string")
    got = rows(K.verify_mentions(t, "id", "t", [("Ice", "《Fire/Ice》"), ("Old Wall", "Old Wall")]).select("key", "written", "state"))
    assert got == [(1, "Old Wall", "bare"), (1, "《Fire/Ice》", "ok"), (3, "《nope》", "unknown")]


def test_all_faces_are_known(spark):
    cards = [
        ("Fire Song // Ice Song", "Fire Song", "Ice Song", "火の歌 // 氷の歌", "火の歌", "氷の歌", False),
        ("Far Gate // Old Wall", "Far Gate", "Old Wall", None, None, None, False),
        ("Old Wall", "Old Wall", None, "古い壁", "古い壁", None, False),
        ("Arena Song", "Arena Song", None, "氷の歌", "氷の歌", None, True),
    ]
    names = K.name_forms(spark.createDataFrame(cards, "card_name string, name_en_front string, name_en_back string, japanese_name string, name_ja_front string, name_ja_back string, digital boolean").collect())
    texts = ["氷の歌とIce Song、火の歌", "《氷の歌》《Ice Song》《氷の歌/Ice Song》", "《火の歌/Fire Song》《火の歌 // 氷の歌》《Fire Song // Ice Song》", "《Old Wall》《Far Gate // Old Wall》《Arena Song》《壁》"]
    got = rows(K.verify_mentions(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", names).select("key", "written", "canonical", "state"))
    ice, fire = "《氷の歌/Ice Song》", "《火の歌/Fire Song》"
    assert got == sorted(
        [
            *[(0, w, c, "bare") for w, c in (("氷の歌", ice), ("Ice Song", ice), ("火の歌", fire))],
            *[(1, w, ice, "ok" if w == ice else "rewrite") for w in ("《氷の歌》", "《Ice Song》", ice)],
            *[(2, w, fire, "ok" if w == fire else "rewrite") for w in (fire, "《火の歌 // 氷の歌》", "《Fire Song // Ice Song》")],
            *[(3, "《Old Wall》", "《古い壁/Old Wall》", "rewrite"), (3, "《Far Gate // Old Wall》", "Far Gate", "rewrite"), (3, "《Arena Song》", "《氷の歌/Arena Song》", "rewrite"), (3, "《壁》", None, "unknown")],
        ],
        key=repr,
    )


def test_bare_names_in_running_text(spark):
    names = ["太陽の指輪", "指輪", "輪", "ケヌの塔", "Old Wall", "Brainstorm", "Opt", "Relgáda", "Ring 2"]
    texts = ["太陽の指輪を入れる。", "毎回太陽の指輪とこの指輪、輪。", "デッキにOld Wallを4枚、Brainstormも", "4Brainstorm3枚", "Brainstorms, Old Walls, XOld Wall, Opt", "強いケヌの塔ー", "Relgádas Relgáda。éBrainstorm", "Ring 2個とRing 2x", "brainstorm", "《太陽の指輪》と太陽の指輪", ""]

    def brute(text):
        taken, found = {i for m in re.finditer("《[^《》]*》", text) for i in range(*m.span())}, []
        for n in sorted(names, key=len, reverse=True):
            japanese = any("ぁ" <= c <= "ヿ" or "一" <= c <= "鿿" for c in n)
            if n in ("輪", "Opt"):  # too short
                continue
            for a in range(len(text)):
                b = a + len(n)
                letters = [c for c in text[max(a - 1, 0) : a] + text[b : b + 1] if re.match("[A-Za-zà-ÿ]", c)]
                if text[a:b].lower() == n.lower() and (japanese or not letters) and not taken & set(range(a, b)):
                    taken |= set(range(a, b))
                    found.append((a, text[a:b]))
        return found

    got = K.verify_mentions(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", [(n, n) for n in names]).where("state = 'bare'").select("key", "at", "written")
    want = sorted(((k, a, w) for k, t in enumerate(texts) for a, w in brute(t)), key=repr)
    assert rows(got) == want
    assert (0, 0, "太陽の指輪") in want and (2, 4, "Old Wall") in want and (3, 1, "Brainstorm") in want and len(want) > 8


def test_mentions_in_blocks_of_the_dictionary(spark, sf_dir, monkeypatch):
    cards = spark.read.parquet(f"{sf_dir}/mtg_cards_v2.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = rows(K.verify_texts(docs, "doc_id", "text", cards))
    listed = K.name_forms(cards.collect())
    assert rows(K.verify_mentions(docs, "doc_id", "text", listed)) == one
    monkeypatch.setattr(K, "BLOCK_NAMES", 4000)
    assert rows(K.verify_texts(docs, "doc_id", "text", cards)) == one and {r[-1] for r in one} >= {"ok", "bare"}


def test_rewriting(spark):
    t = spark.createDataFrame([(1, "Ice and 《Ice》, 《Fire/Ice》. Old Wall"), (2, "none"), (3, None)], "id int, t string")
    m = K.verify_mentions(t, "id", "t", [("Frost", "《Fire/Ice》"), ("Ice", "《Fire/Ice》"), ("Old Wall", "《壁/Old Wall》")])
    got = {r["key"]: (r["text"], r["n_changed"]) for r in K.rewritten(t, "id", "t", m).collect()}
    assert got == {1: ("Ice and 《Fire/Ice》, 《Fire/Ice》. 《壁/Old Wall》", 2), 2: ("none", 0), 3: (None, 0)}


def test_pair_counts_with_hot_baskets(spark, monkeypatch):
    from collections import Counter
    from itertools import combinations, product

    from tallyloom.operators import pairs as X

    monkeypatch.setattr(X, "HOT_SHARE", 0.3)
    left = [(s, b, i) for s in (1, 2) for b in range(6) for i in range(b * 2)] + [(1, 99, i) for i in range(60)] + [(1, None, 1), (1, 2, None)]
    right = [(s, b, i) for s in (1, 2) for b in range(3, 8) for i in range(3, 3 + b)] + [(1, 99, i) for i in range(5)]
    a, b = (spark.createDataFrame([(*r, 0) for r in x], "s int, b int, i int, n int") for x in (left, right))
    sets = [{}, {}]
    for k, data in enumerate((left, right)):
        for s, x, i in data:
            if x is not None and i is not None:
                sets[k].setdefault((s, x), set()).add(i)
    one = Counter((s, *p) for (s, _), v in sets[0].items() for p in combinations(sorted(v), 2))
    two = Counter((k[0], *p) for k, v in sets[0].items() for p in product(v, sets[1].get(k, ())))
    for chunk in (4, 256):
        assert {tuple(r)[:3]: r["n"] for r in X.pair_counts(a, ["s", "b"], "i", chunk, ["s"]).collect()} == one
        assert {tuple(r)[:3]: r["n"] for r in X.cross_counts(a, b, ["s", "b"], "i", chunk, ["s"]).collect()} == two
    assert X.pair_counts(a.limit(0), ["s", "b"], "i").count() == 0 and X.cross_counts(a, b.limit(0), ["s", "b"], "i").count() == 0


def test_answers_on_fixtures(spark):
    from tallyloom.operators import answers as A

    cards = spark.createDataFrame(
        [(1, "Fire Song", "火の歌", False, 5, {"modern": "legal"}, "Instant", "deal 2 harm"), (2, "Fire", None, False, None, {"modern": "banned"}, "Instant", "song of fire"), (3, "Fire Hall", None, True, 1, {}, "Land", None), (4, "Icy Hall", "氷", False, 2, {"modern": "legal"}, "Land", "a hall")],
        "id int, card_name string, japanese_name string, digital boolean, edhrec_rank int, legalities map<string,string>, type_line string, oracle_text string",
    )
    q = spark.createDataFrame([("fire",), ("火",), ("hall land",), ("Fyre Song",), ("zzzz",), (" ",), (None,)], "query string")
    text = ["card_name", "japanese_name", "type_line", "oracle_text"]
    got = {}
    for r in A.search_cards(q, "query", cards, text, 2).collect():
        got.setdefault(r["query"], []).append((r["status"], r["id"], r["stage"]))
    got = {k: sorted(v, key=repr) for k, v in got.items()}
    assert got["fire"] == [("ok", 1, 0), ("ok", 2, 0)] and got["火"] == [("ok", 1, 0)] and got["hall land"] == [("ok", 4, 1)] and got["Fyre Song"] == [("ok", 1, 2)]
    assert got["zzzz"] == [("no match", None, None)] and got[" "] == got[None] == [("bad input", None, None)]
    assert {r["id"] for r in A.search_cards(q.where("query = 'fire'"), "query", cards, text, 5, legal="modern").collect()} == {1}
    assert {r["id"] for r in A.search_cards(q.where("query = 'fire'"), "query", cards, text, 5, digital=None).collect()} == {1, 2, 3}
    assert A.search_cards(q, "query", cards.limit(0), text).where("status = 'ok'").count() == 0

    rules = spark.createDataFrame([("702.1", False, "A trampling creature deals damage"), ("702.1a", False, "tramples over blockers"), ("702.19", False, "other rule"), ("Trample", True, "trample"), ("702.1.2", False, "x-y z")], "number string, is_glossary boolean, body string")
    asked = spark.createDataFrame([("702.1",), ("702.1.",), ("trample",), ("trample rule zebra",), ("x-y",), ("qqq",), ("",)], "query string")
    found = {}
    for r in A.find_rules(asked, "query", rules, 5).orderBy("place").collect():
        found.setdefault(r["query"], []).append((r["mode"], r["number"]) if r["status"] == "ok" else r["status"])
    assert found["702.1"] == found["702.1."] == [("number", "702.1"), ("number", "702.1.2"), ("number", "702.1a")]
    assert found["trample"][0] == ("all", "Trample") and len(found["trample"]) == 3 and found["trample rule zebra"][0][0] == "any" and found["x-y"][0] == ("all", "702.1.2")
    assert found["qqq"] == ["no match"] and found[""] == ["bad input"]
    k = A.first_with_more(spark.range(5).withColumn("g", F.lit(1)), ["g"], [F.col("id")], 5)
    assert {r["more"] for r in k.collect()} == {False} and {r["more"] for r in A.first_with_more(spark.range(6).withColumn("g", F.lit(1)), ["g"], [F.col("id")], 5).collect()} == {True}


def test_scopes_and_packs(spark):
    scopes = spark.createDataFrame([("ABC", "Alpha Bay"), ("BAY", "Bay of Stars"), ("XYZ", None)], "code string, name string")
    q = spark.createDataFrame([("#draft abc",), ("Sealed: alpha bay",), ("stars",), ("bay",), ("Limited",), ("alph",), ("nope",), (None,)], "q string")
    got = {r["q"]: (r["code"], r["status"]) for r in G.resolve_scopes(q, "q", scopes.withColumn("key", F.col("code")), "key", "code", "name").withColumnRenamed("key", "code").collect()}
    assert got == {"#draft abc": ("ABC", "resolved"), "Sealed: alpha bay": ("ABC", "resolved"), "stars": ("BAY", "resolved"), "bay": ("BAY", "resolved"), "Limited": (None, "unknown"), "alph": ("ABC", "resolved"), "nope": (None, "unknown"), None: (None, "unknown")}
    stats = spark.createDataFrame([("S", "Wall", 400, 0.5, 2.0), ("S", "Twin", 1, 0.5, 2.0), ("S", "twin", 2, 0.5, 2.0), ("T", "Hill", 900, 0.5, 2.0)], "expansion string, card_name string, gih_games int, gih_wr double, alsa double")
    packs = spark.createDataFrame([("S", x) for x in ("wall", "TWIN", "Hill", "Typo", None)] + [("T", "Hill")], "expansion string, card_name string")
    known = spark.createDataFrame([("Wall",), ("Twin",), ("Hill",)], "n string")
    got = {(r["expansion"], r["name"]): (r["status"], r["small_sample"]) for r in G.pack_report(packs, "card_name", stats, "expansion", known, "n").collect()}
    assert got == {("S", "wall"): ("exact", True), ("S", "TWIN"): ("ambiguous", None), ("S", "Hill"): ("not in set", None), ("S", "Typo"): ("unverified", None), ("T", "Hill"): ("exact", False)}


def test_reload_is_atomic(spark, tmp_path):
    M.reload_table(spark.range(3), str(tmp_path / "t"))
    old = M.current_table(spark, str(tmp_path / "t"))
    with pytest.raises(Exception, match="bad"):
        M.reload_table(spark.range(5).select(F.raise_error(F.lit("bad")).cast("bigint").alias("id")), str(tmp_path / "t"))
    assert M.current_table(spark, str(tmp_path / "t")).count() == old.count() == 3
    M.reload_table(spark.range(7), str(tmp_path / "t"))
    assert M.current_table(spark, str(tmp_path / "t")).count() == 7 and old.count() == 3

import random

from pyspark.sql import functions as F

from feedloom.llm import truncation as T

PARTS = ["the fan", "the belt", "my old printer", "the left head", "the plate", "a new nozzle"], ["stops", "rattles", "gets warm", "stays cold", "drifts a little"], ["after two hours", "in the morning", "on tall parts", "near the corner", "for no reason"]
SCHEMA = "record_id bigint, source string, text string, chars string, cut int"


def text(rnd):
    return " ".join(" ".join(rnd.choice(p) for p in PARTS).capitalize() + "." for _ in range(rnd.randint(2, 12)))


def corpus(seed=4, n=1500):
    rnd, rows, cases = random.Random(seed), [], set()
    for i in range(n):
        t, source = text(rnd), ("cut", "bytes", "whole")[i % 3]
        if source == "cut" and len(t) > 160:
            t = t[:160]
            cases |= {i} if not t.endswith(".") else set()
        elif source == "bytes" and len(t) > 200:
            t = t[:190].rsplit(" ", 1)[0] + " [...]"
            cases.add(i)
        elif i % 30 == 5:  # cut in mid-transfer, within a word
            at = next(a for a in iter(lambda: rnd.randrange(30, len(t)), None) if t[a - 2 : a + 1].isalpha())
            t = t[:at]
            cases.add(i)
        elif i % 10 == 2:
            t = t[:-1]  # finished without a mark
        rows.append((i, source, t, None, None))
    rows += [(n, "whole", None, None, None), (n + 1, "whole", "", None, None), (n + 2, "cut", "   ", None, None), (n + 3, None, "It works.", None, None), (n + 4, "whole", "88, 64, 44", "", 1)]
    rows += [(n + 5, "whole", text(random.Random(9)) * 400, None, None), (n + 6, "whole", "Great stuff 🙂", None, None)]
    return rows, cases


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return T.truncated(T.prepared(df, "t", "record_id", "text", "source"), **how)


def test_planted_cuts(spark):
    rows, cases = corpus()
    out = found(spark, rows)
    got = {r.record_id for r in out.where("cut").collect()}
    assert len(got & cases) >= 0.95 * len(cases) and len(got - cases) <= 0.03 * len(cases)
    assert out.where("record_id >= 1500").count() == 4  # null and empty texts have no row
    assert not got & set(range(1500, 1507))
    by = {r.record_id: r.by for r in out.where("cut").collect()}
    assert all(by[i] == ("mid-transfer" if i % 3 == 2 else "limit") for i in got & cases if i % 3 == 2 or i % 3 == 1)


def test_blocks_of_contexts_change_nothing(spark, monkeypatch):
    rows, _ = corpus(n=400)
    whole = {r.record_id: (r.finished, r.seen, r.cut, r.by) for r in found(spark, rows).collect()}
    shuffled = []
    written = T.written
    monkeypatch.setattr(T, "written", lambda df, name: shuffled.append(name) or written(df, name))
    parts = {r.record_id: (r.finished, r.seen, r.cut, r.by) for r in found(spark, rows, block_bits=1 << 12).collect()}
    assert parts == whole and shuffled.count("contexts") > 1
    assert {by for *_, cut, by in whole.values() if cut} == {"limit", "mid-transfer"} and all((by is not None) == cut for *_, cut, by in whole.values())


def test_a_full_filter_shuffles_no_more_than_its_block(spark):
    rows, _ = corpus(n=300)
    texts = T.prepared(spark.createDataFrame(rows, SCHEMA), "t", "record_id", "text", "source")
    asked = T.written(T.endings(texts).select(F.explode(F.array(*T._KINDS)).alias("h")).distinct(), "asked")
    held = {r.h for r in asked.collect()}
    got = T.context_counts(texts, asked, block_bits=1 << 10)
    counted = [r.h for r in got.collect()]
    # every context that the corpus has is counted once, and few that nobody asked for
    assert len(counted) == len(set(counted)) and {r.h for r in T.context_counts(texts, asked).collect()} & held == set(counted) & held
    assert len(set(counted) - held) <= 0.1 * len(counted) + 20


def test_endings_of_any_length(spark):
    word = "x" * 250
    rows = [(1, "a", "The fan stops\n--\n" + "m" * 300, "", 1), (2, "a", "The fan stops at " + word, "", 1), (3, "a", "The belt " + word, "", 1), (4, "a", "The fan stops at " + word + "y", "", 1), (5, "a", "The fan st" + " " * 60 + "[ ... ]" + "\n" * 40, "", 1)]
    texts = T.prepared(spark.createDataFrame(rows, SCHEMA), "t", "record_id", "text", "source")
    got = {r.record_id: (r.body, r.marker) for r in texts.collect()}
    assert got[1] == ("The fan stops", "") and got[5] == ("The fan st", "[ ... ]")
    e = {r.record_id: r for r in T.endings(texts).collect()}
    assert e[2].single == e[3].single != e[4].single and e[2].pair != e[3].pair
    whole = {r.record_id: r for r in T.endings(texts, tail=10_000).collect()}
    assert e == whole


def test_limits(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    limits = T.limits_of(T.endings(T.prepared(df, "t", "record_id", "text", "source"))).collect()
    assert any(r.source == "cut" and r.unit == "chars" and r.width == 1 and r.bin == 160 for r in limits)
    assert not any(r.source == "whole" and r.width == 1 for r in limits)


def test_lengths_without_an_end_count_as_neighbours(spark):
    lengths = [5, 23, 40, 77, 101] + [160] * 15
    rows = [("t", s, "chars", n + d) for s, d in (("a", 0), ("b", 2)) for n in lengths] + [("t", "far", "chars", 7), ("t", "far", "chars", 10_000_000)]
    hazards = T.length_hazards(spark.createDataFrame(rows, "table_name string, source string, unit string, length bigint"), false_discovery=1.0, ratio=0.0, least=1).where("width = 1").collect()
    got = {(r.source, r.bin): r for r in hazards}
    for (source, at), r in got.items():
        mine = [n for _, s, _, n in rows if s == source]
        near = [b for b in range(max(1, at - 12), at + 13) if abs(b - at) > 1]
        want = (sum(mine.count(b) for b in near) + 0.5) / (sum(sum(n >= b for n in mine) for b in near) + 1)
        assert abs(r.around - min(want, 0.999)) < 1e-9 and r.at_risk == sum(n >= at for n in mine) and r.ended == mine.count(at)
    assert ("a", 160) in got
    found = T.length_hazards(spark.createDataFrame(rows, "table_name string, source string, unit string, length bigint"))
    assert {(r.source, r.bin) for r in found.where("width = 1").collect()} == {("a", 160), ("b", 162)}


def test_numbers_at_the_end_of_prose_do_not_close_it(spark):
    rows = [(1, "a", "The fan stops at " + "12 " * 120 + "1", "", 1), (2, "a", "12 " * 120 + "1", "", 1), (3, "a", "日本 " + "12 " * 120 + "1", "", 1)]
    got = T.endings(T.prepared(spark.createDataFrame(rows, SCHEMA), "t", "record_id", "text", "source")).collect()
    assert {r.record_id: r.closed for r in got} == {1: False, 2: True, 3: False}


def test_rates_and_empty_tables(spark):
    rows, _ = corpus(n=300)
    df = spark.createDataFrame(rows, SCHEMA)
    every = df.select(F.lit("t").alias("table_name"), "source")
    rates = {r.source: r for r in T.rates(found(spark, rows), every).collect()}
    assert all(r.cut == r.at_limit + r.mid_transfer for r in rates.values())
    assert rates["cut"].records == 101 and 0 < rates["cut"].share < 1 and rates[""].cut == 0
    assert found(spark, []).count() == 0


def test_what_stands_after_a_break(spark):
    rows = [(1, "a", "The fan stops\n--\nmail.example #12", "", 1), (2, "a", "The fan st…", "", 1), (3, "a", "The fan st [...] ", "", 1), (4, "a", "Well...", "", 1)]
    got = {r.record_id: (r.body, r.marker) for r in T.prepared(spark.createDataFrame(rows, SCHEMA), "t", "record_id", "text", "source").collect()}
    assert got == {1: ("The fan stops", ""), 2: ("The fan st", "…"), 3: ("The fan st", "[...]"), 4: ("Well", "...")}

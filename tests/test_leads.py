"""Ranking, audit, change, classification and merging."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from leadflow import sinks
from leadflow.operators import audit, candidates as c, dedupe, ranking
from leadflow.operators.components import components
from leadflow.operators.ranking import rank_rows


@pytest.mark.parametrize("n", [None, 1, 40])
def test_rank_with_a_hot_group(spark, n, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 3)
    rnd = random.Random(3)
    data = [(i, "hot" if rnd.random() < 0.4 else f"s{rnd.randint(0, 5)}", rnd.choice([0, 0, 0, 8, 94])) for i in rnd.sample(range(5000), 2000)]
    df = spark.createDataFrame(data, "lead_seq bigint, source_id string, attention_score int")
    got = {r["lead_seq"]: r["rank"] for r in rank_rows(df, ["source_id"], "attention_score", "lead_seq", partitions=n).collect()}
    want = {}
    for s in {x[1] for x in data}:
        for n, row in enumerate(sorted((x for x in data if x[1] == s), key=lambda x: (-x[2], x[0])), 1):
            want[row[0]] = n
    assert got == want


def test_audit_keeps_every_row_and_caps_last(spark):
    base = dict(source_id="s", url="https://example.com/1", attention_score=90, market_relevant=True, retain_all_leads=False, allowed_domains=["example.com"], discovery_only=False,
                window_status="current", date_precision="time", article_url_pattern=None)
    changes = [dict(), dict(window_status="old"), dict(window_status="future", date_precision="day"), dict(window_status="date_needs_review", date_precision="missing"),
               dict(attention_score=24), dict(attention_score=0, market_relevant=False, retain_all_leads=True), dict(url="https://example.org/x"), dict(discovery_only=True),
               dict(article_url_pattern=r"/release/"), dict(attention_score=95), dict(attention_score=90, url="https://example.com/gone")]
    rows = [dict(base, lead_seq=i, **{**ch}) if not set(ch) & set(base) else {**base, **ch, "lead_seq": i} for i, ch in enumerate(changes)]
    schema = ("lead_seq bigint, source_id string, url string, attention_score int, market_relevant boolean, retain_all_leads boolean, allowed_domains array<string>, "
              "discovery_only boolean, window_status string, date_precision string, article_url_pattern string")
    articles = spark.createDataFrame([("https://example.com/1", "readable")], "url string, access_status string")
    run = lambda n: {r["lead_seq"]: (r["stage"], r["access_status"]) for r in audit.headline_audit(spark.createDataFrame(rows, schema), articles, n).collect()}
    got = run(12)
    assert len(got) == len(rows)
    assert [got[i][0] for i in range(11)] == ["article_checked", "outside_window", "outside_window", "article_checked", "below_attention_threshold", "article_checked", "outside_source_domains",
                                             "document_review_pending", "candidate_selected", "article_checked", "article_unavailable"]
    assert got[0][1] == "readable" and got[10][1] == "unavailable" and got[1][1] is None
    # Highest score first, then order of arrival; only rows that reach the cap are counted.
    capped = run(2)
    assert [i for i, s in capped.items() if s[0] == "article_checked"] == [0, 9] or {i for i, s in capped.items() if s[0] == "article_checked"} == {0, 9}
    assert {i for i, s in capped.items() if s[0] == "article_cap_pending"} == {3, 5, 10}


def test_change_status(spark):
    lead = lambda i, url, title: (i, url, title, "body")
    leads = spark.createDataFrame([lead(1, "https://example.com/a", "A"), lead(2, "https://example.com/b", "new B"), lead(3, "https://example.com/c", "C"), lead(4, "https://example.com/d", "D")],
                                  "lead_seq bigint, url string, title string, text string")
    known = c.with_identity(spark.createDataFrame([lead(1, "https://example.com/a?utm_source=x", "A"), lead(2, "https://example.com/b", "old B"), lead(4, "https://example.com/d", "D")],
                                                  "lead_seq bigint, url string, title string, text string"))
    state = known.select("id", "content_hash", "title", F.when(F.col("lead_seq") == 4, F.lit("2026-09-24")).otherwise(F.lit("2026-09-23")).cast("date").alias("edition_date"))
    got = {r["lead_seq"]: r for r in c.change_status(c.with_identity(leads), state, "2026-09-24").collect()}
    assert [got[i]["change"] for i in (1, 2, 3, 4)] == ["unchanged", "changed", "new", "unchanged"]
    assert got[2]["previous_title"] == "old B" and [got[i]["seen_before"] for i in (1, 2, 3, 4)] == [True, False, False, False]


def gates(spark, **kw):
    row = dict(tickers=["1 JP"], broad=False, topic="text", window_status="current", change="new", seen_before=False, timing_resolved=True, publisher=False, access_status="readable",
               language="en", discovery_only_tickers=[], inactive_markets=[], text="t", event_type="Company update", article_error="")
    row.update(kw)
    schema = ("tickers array<string>, broad boolean, topic string, window_status string, change string, seen_before boolean, timing_resolved boolean, publisher boolean, access_status string, "
              "language string, discovery_only_tickers array<string>, inactive_markets array<string>, text string, event_type string, article_error string")
    r = c.classify(spark.createDataFrame([row], schema)).withColumn("eligible", c.is_eligible()).withColumn("flags", c.flags()).first()
    return r["outcome"], r["eligible"], r["flags"]


def test_gates_in_order(spark):
    assert gates(spark)[:2] == ("current", True)
    assert gates(spark, tickers=[], topic="none")[0] == "no_watchlist_match" and gates(spark, tickers=[], broad=True)[:2] == ("current", False)
    assert gates(spark, topic="none", window_status="future")[0] == "topic_not_matched" and gates(spark, topic="discovery")[:2] == ("current", False)
    assert gates(spark, window_status="old")[0] == "old" and gates(spark, window_status="old", change="changed")[:2] == ("date_needs_review", False)
    assert gates(spark, change="unchanged", seen_before=True)[0] == "previous_edition_unchanged" and gates(spark, change="unchanged")[:2] == ("current", True)
    assert not gates(spark, timing_resolved=False)[1] and not gates(spark, publisher=True, access_status="restricted")[1] and not gates(spark, publisher=True, language="ja")[1]
    assert gates(spark, publisher=True, language="ja", access_status="restricted", text="", event_type="Tender/deadline", timing_resolved=False, inactive_markets=["VN"])[2] == [
        "No active news window yet for: VN.", c.FLAG_NOVELTY, c.FLAG_LANGUAGE, c.FLAG_HEADLINE, c.FLAG_TENDER,
        "Article not fully available: restricted. Discovery lead only; do not infer the full story.", c.FLAG_ENGLISH]


def sequential(rows):
    """The rule read row by row."""
    kept, by_text, copies = {}, {}, []
    for r in sorted(rows, key=lambda r: r["seq"]):
        if r["readable"] and r["signature"] in by_text:
            owner = kept[by_text[r["signature"]]]
            copies.append((owner["seq"], r["seq"]))
            owner["tickers"] = list(dict.fromkeys(owner["tickers"] + r["tickers"]))
        elif r["older_duplicate"]:
            continue
        elif r["id"] not in kept:
            kept[r["id"]] = dict(r)
            if r["readable"]:
                by_text[r["signature"]] = r["id"]
        else:
            kept[r["id"]]["tickers"] = list(dict.fromkeys(kept[r["id"]]["tickers"] + r["tickers"]))
    return {r["seq"]: r["tickers"] for r in kept.values()}, sorted(copies)


@pytest.mark.parametrize("seed,n_ids,n_texts", [(1, 30, 30), (2, 200, 8), (3, 8, 200), (4, 100, 100)])
def test_merge_equals_the_sequential_rule(spark, seed, n_ids, n_texts):
    rnd = random.Random(seed)
    rows = []
    for seq in rnd.sample(range(10_000), 300):
        text = 0 if rnd.random() < 0.33 else rnd.randint(0, n_texts)
        rows.append(dict(seq=seq, id=f"i{rnd.randint(0, n_ids)}", signature=f"t{text}", readable=rnd.random() < 0.8, older_duplicate=rnd.random() < 0.1,
                         tickers=rnd.sample(["A", "B", "C", "D"], rnd.randint(0, 3)), canonical=f"u{seq}"))
    df = spark.createDataFrame(rows, "seq bigint, id string, signature string, readable boolean, older_duplicate boolean, tickers array<string>, canonical string")
    kept, copies = dedupe.dedupe_candidates(df)
    want_kept, want_copies = sequential(rows)
    assert {r["seq"]: r["tickers"] for r in kept.collect()} == want_kept
    assert sorted((r["owner_seq"], r["seq"]) for r in copies.collect()) == want_copies
    counts = {r["seq"]: r["also_reported_count"] for r in kept.collect()}
    assert sum(counts.values()) == len(want_copies)


MERGE = "seq bigint, id string, signature string, readable boolean, older_duplicate boolean, tickers array<string>, canonical string"


def chain(n, order):
    """Ids that share texts in turn: id k has texts k and k + 1, in the given order of arrival."""
    rows = [dict(id=f"i{k}", signature=f"t{k + j}", readable=True, older_duplicate=False, tickers=[f"T{k % 5}"], canonical="u") for k in range(n // 2) for j in (0, 1)]
    for seq, at in enumerate(order(len(rows))):
        rows[at]["seq"] = seq
    return rows


@pytest.mark.parametrize("order", [lambda n: range(n), lambda n: range(n - 1, -1, -1), lambda n: random.Random(1).sample(range(n), n)], ids=["rising", "falling", "shuffled"])
def test_a_long_chain_is_merged_in_few_rounds(spark, order):
    rows = chain(10_000, order)
    df = spark.createDataFrame(rows, MERGE)
    kept = {r["seq"] for r in dedupe.owners(df).collect()}
    assert kept == set(sequential(rows)[0])
    edges = spark.createDataFrame([(a["seq"], b["seq"]) for a, b in zip(rows, rows[1:])], "a long, b long")
    roots, rounds = components(edges)
    assert rounds <= 16 and roots.count() == len(rows) - 1 and {r["root"] for r in roots.collect()} == {0}


def test_components_over_the_stated_size_go_by_rounds(spark):
    rows = chain(60, lambda n: random.Random(2).sample(range(n), n)) + [dict(seq=1000 + k, id=f"j{k % 3}", signature=f"s{k % 4}", readable=k % 5 > 0, older_duplicate=False, tickers=[], canonical="u") for k in range(40)]
    df = spark.createDataFrame(rows, MERGE)
    wanted = set(sequential(rows)[0])
    assert {r["seq"] for r in dedupe.owners(df, component_rows=5).collect()} == wanted == {r["seq"] for r in dedupe.owners(df).collect()}


def test_a_hot_text_leaves_one_pair_and_no_rounds(spark, monkeypatch):
    rows = [dict(seq=k, id=f"i{k}", signature="hot", readable=True, older_duplicate=False, tickers=["A"], canonical="u") for k in range(500)]
    rows += [dict(seq=600 + k, id="one", signature=f"t{k}", readable=True, older_duplicate=False, tickers=["B"], canonical="u") for k in range(300)]
    found = []
    monkeypatch.setattr(dedupe, "components", lambda edges: found.append(components(edges)) or found[-1])
    kept, copies = dedupe.dedupe_candidates(spark.createDataFrame(rows, MERGE))
    assert {r["seq"] for r in kept.collect()} == {0, 600} and copies.count() == 499 and found[0][1] == 0


def test_discovery_matches_come_from_copies_of_the_text_only(spark):
    row = lambda seq, one, text, found: dict(seq=seq, id=one, signature=text, readable=True, older_duplicate=False, tickers=[f"T{seq}"], canonical="u", discovery_matches=found)
    rows = [row(1, "a", "x", ["P", "Q"]), row(2, "b", "x", ["Q", "R"]), row(3, "a", "y", ["S"]), row(4, "c", "z", None)]
    kept, _ = dedupe.dedupe_candidates(spark.createDataFrame(rows, MERGE + ", discovery_matches array<string>"))
    assert {r["seq"]: (r["tickers"], r["discovery_matches"]) for r in kept.collect()} == {1: (["T1", "T2", "T3"], ["P", "Q", "R"]), 4: (["T4"], [])}


def test_select_edition(spark):
    rows = [(i, 50 + i % 3, "changed" if i % 5 == 0 else "new", "Company update" if i % 2 else "Deal", [f"{i % 4} JP"], i % 7 != 0) for i in range(60)]
    df = spark.createDataFrame(rows, "lead_seq bigint, attention_score int, change string, event_type string, tickers array<string>, eligible boolean")
    got = c.select_edition(df, 10).collect()
    best = sorted((r for r in rows if r[5]), key=lambda r: (-r[1], r[2] != "changed", r[3] == "Company update", r[4], r[0]))[:10]
    assert len(got) == 60 and [r["lead_seq"] for r in sorted((g for g in got if g["selected"]), key=lambda g: g["position"])] == [r[0] for r in best]


def state_rows(spark, rows):
    return spark.createDataFrame(rows, "lead_seq bigint, id string, content_hash string, title string, canonical string, published timestamp")


def test_state_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert sinks.read_state(spark, path).count() == 0 and sinks.latest_version(spark, path) == -1
    first = sinks.advance_state(spark, path, state_rows(spark, [(1, "a", "h1", "A", "u", None), (2, "b", "h2", "B", "u", None)]), "2026-09-23", "r1")
    assert first.count() == 2 and sinks.latest_version(spark, path) == 0
    later = state_rows(spark, [(3, "b", "h3", "B2", "u", None)])
    assert sinks.advance_state(spark, path, later, "2026-09-24", dry_run=True).count() == 2 and sinks.latest_version(spark, path) == 0
    for _ in range(2):  # the retry of a run that has been committed changes nothing
        sinks.advance_state(spark, path, later, "2026-09-24", "r2")
    assert sinks.latest_version(spark, path) == 1
    after = {r["id"]: (r["content_hash"], str(r["edition_date"])) for r in sinks.read_state(spark, path).collect()}
    assert after == {"a": ("h1", "2026-09-23"), "b": ("h3", "2026-09-24")}
    assert {r["content_hash"] for r in sinks.read_state(spark, path, 0).collect()} == {"h1", "h2"}


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "state")
    mine, other = (state_rows(spark, [(1, i, "h", "T", "u", None)]) for i in ("mine", "other"))
    empty = sinks.read_state(spark, path)
    upsert = lambda rows: c.upsert_state(empty, rows, "2026-09-23")
    assert sinks.write_state(upsert(other), path, -1, "other") == 0
    with pytest.raises(sinks.CommitConflict):
        sinks.write_state(upsert(mine), path, -1, "mine")
    assert [r["id"] for r in sinks.read_state(spark, path).collect()] == ["other"]
    # Both have written their data when one commits.
    commits = sinks.Commits(spark, f"{path}/_versions")
    commits.add(f"{1:020d}", {"version": 1, "folder": "data/none", "run_id": "x"})
    with pytest.raises(sinks.CommitConflict):
        commits.add(f"{1:020d}", {"version": 1, "folder": "data/other", "run_id": "y"})
    assert commits.read(f"{1:020d}")["run_id"] == "x"
    # A writer that was ended inside its commit.
    (tmp_path / "state" / "_versions" / f"{2:020d}.json").touch()
    assert sinks.latest_version(spark, path) == 1
    with pytest.raises(sinks.CommitConflict):
        commits.add(f"{2:020d}", {"version": 2})
    os.utime(tmp_path / "state" / "_versions" / f"{2:020d}.json", (0, 0))
    commits.add(f"{2:020d}", {"version": 2})
    assert sinks.latest_version(spark, path) == 2


def test_a_writer_ended_before_its_commit_leaves_nothing_to_read(spark, tmp_path, monkeypatch):
    path, runs = str(tmp_path / "state"), str(tmp_path / "runs")
    sinks.advance_state(spark, path, state_rows(spark, [(1, "a", "h1", "A", "u", None)]), "2026-09-23", "r1")

    class Ended(BaseException):
        pass

    def ended(*_):
        raise Ended

    with monkeypatch.context() as patch:
        patch.setattr(sinks.Commits, "add", ended)
        with pytest.raises(Ended):
            sinks.advance_state(spark, path, state_rows(spark, [(2, "b", "h2", "B", "u", None)]), "2026-09-24", "r2")
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception):
        sinks.write_run({"audit": spark.range(3), "candidates": broken}, runs, "2026-09-24", "r1")
    assert sinks.latest_version(spark, path) == 0 and [r["id"] for r in sinks.read_state(spark, path).collect()] == ["a"]
    with pytest.raises(ValueError):
        sinks.read_run(spark, runs, "audit")
    # The same run is written again as a whole; what the first attempt left is not read.
    sinks.write_run({"audit": spark.range(2), "candidates": spark.range(1)}, runs, "2026-09-24", "r1")
    assert sinks.read_run(spark, runs, "audit").count() == 2
    sinks.advance_state(spark, path, state_rows(spark, [(2, "b", "h2", "B", "u", None)]), "2026-09-24", "r2")
    assert sinks.read_state(spark, path).count() == 2 and len(sinks.expire_state(spark, path, 1)) == 2 and sinks.read_state(spark, path).count() == 2


def test_run_folders(spark, tmp_path):
    runs = str(tmp_path / "runs")
    sinks.write_run({"audit": spark.range(3)}, runs, "2026-09-24", "r1")
    with pytest.raises(sinks.CommitConflict):
        sinks.write_run({"audit": spark.range(3)}, runs, "2026-09-24", "r1")
    sinks.write_run({"audit": spark.range(2)}, runs, "2026-09-24", "r2")
    sinks.write_run({"audit": spark.range(1)}, runs, "2026-09-25", "r1")
    assert sinks.read_run(spark, runs, "audit").count() == 6 and sinks.read_run(spark, runs, "audit", "2026-09-24").count() == 5
    assert sinks.read_run(spark, runs, "audit", run_id="r1").columns == ["id", "edition_date", "run_id"] and len(sinks.runs(spark, runs)) == 3


def test_id_and_hash(spark):
    row = c.with_identity(spark.createDataFrame([("https://Example.com/a#x", " T  t ", "b\n b")], "url string, title string, text string")).first()
    assert row["id"] == hashlib.sha256(b"https://example.com/a").hexdigest()[:20] and row["content_hash"] == hashlib.sha256("T t\nb b".encode()).hexdigest()


def test_priority_sources_need_a_name(spark):
    schema = ("lead_seq bigint, source_id string, url string, attention_score int, market_relevant boolean, retain_all_leads boolean, allowed_domains array<string>, discovery_only boolean, "
              "window_status string, date_precision string, broad boolean, fixed_issuer boolean, tickers array<string>")
    row = lambda i, broad, fixed, tickers: (i, "s", "https://example.com/", 0, False, False, ["example.com"], False, "current", "time", broad, fixed, tickers)
    df = spark.createDataFrame([row(1, False, False, []), row(2, False, True, []), row(3, False, False, ["1 JP"]), row(4, True, False, [])], schema)
    got = {r["lead_seq"]: r["stage"] for r in audit.early_stage(df).collect()}
    assert got == {1: "discovery_no_name_match", 2: "article_pending", 3: "article_pending", 4: "below_attention_threshold"}


def test_candidate_tickers(one):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(c.candidate_tickers(arr("b", "a"), arr("a", "c"), arr("c", "a"))) == ["a", "c"]


def test_rank_rows_keeps_rows_without_score_or_group(spark):
    rows = [(1, "s", 5), (2, "s", None), (3, None, 5), (4, None, None), (5, "s", 9), (6, "s", None)]
    df = spark.createDataFrame(rows, "seq long, source_id string, score int")
    got = {r["seq"]: r["rank"] for r in rank_rows(df, ["source_id"], "score", "seq", partitions=4).collect()}
    assert got == {5: 1, 1: 2, 2: 3, 6: 4, 3: 1, 4: 2}


def test_ranks_gather_no_group(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.lit("all").alias("list"), (F.col("id") % 7).alias("score"))
    plan = rank_rows(df, ["list"], "score", "seq", partitions=20)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("Window [") <= 2 and all("_block" in line for line in plan.splitlines() if " Window [" in line)

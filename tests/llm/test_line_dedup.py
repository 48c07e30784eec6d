from collections import defaultdict

from conftest import ODD, documents, sentence

from quillspark.llm.line_dedup import dedup_lines


def brute_force(rows, min_sites=5):
    first = {}
    for _, text, site in rows:
        first[text] = min(site, first.get(text, site))
    sites = defaultdict(set)
    for text, site in first.items():
        for line in (text or "").split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")].add(site)
    gone = {k for k, v in sites.items() if len(v) >= min_sites}
    out = []
    for i, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if x.strip(" ") not in gone]
        out.append((i, text if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in df.collect()), key=str)


def test_spread_lines_go_and_copies_stay(spark, rng):
    rows = []
    for i in range(120):
        lines = [sentence(rng, 12) for _ in range(6)]
        lines.insert(rng.randint(0, 6), "This line stands on very many sites of the web")
        if i % 30 == 0:
            lines.append("  This line stands on four sites and no more  ")
        lines.append("short one")
        rows.append((i, "\n".join(lines), f"site{i % 40}"))
    # short lines and lines that fill most of a text are no exceptions
    rows += [(500 + i, f"own {i}\nhm.\n" + "A very long passage that stands on all of these sites and nowhere else " * 3, f"site{i}") for i in range(6)]
    copy = "\n".join(sentence(rng, 12) for _ in range(5))
    rows += [(1000 + i, copy, f"site{i % 40}") for i in range(60)]
    df = documents(spark, rows, "key line removed found cut row _key n_lines")
    result = dedup_lines(df)
    assert found(result) == brute_force(rows)
    assert result.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    kept = {r.doc_id: r["_key"] for r in result.collect()}
    assert all(k == v for k, v in kept.items())
    assert {r.text for r in result.collect() if r.doc_id >= 1000} == {copy}
    assert {r.text for r in result.collect() if 500 <= r.doc_id < 1000} == {f"own {i}" for i in range(6)}


def test_thresholds_are_exact(spark):
    for n in (4, 5, 6, 7):
        rows = [(i, "The line in question is this one\n" + f"own words of document number {i} " * 4, f"s{i % n}") for i in range(3 * n)]
        assert found(dedup_lines(documents(spark, rows))) == brute_force(rows)


def test_odd_rows_and_empty_table(spark):
    rows = [(i, t, "s0") for i, t in [*ODD, *ODD[:3]]]
    assert found(dedup_lines(documents(spark, rows))) == brute_force(rows)
    assert dedup_lines(documents(spark, [])).collect() == []

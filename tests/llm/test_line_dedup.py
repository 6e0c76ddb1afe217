from sitelens.llm import line_dedup, queries


def brute(texts):
    first, out = {}, set()
    for i in sorted(texts):
        for start, end, digest in sorted(line_dedup.units(texts[i] or "")):
            if digest in first:
                out.add((i, start, end, *first[digest]))
            else:
                first[digest] = (i, start)
    return out


def test_matches_brute_force(spark, sf, documents):
    got = queries.op1_line_dedup(spark, sf).collect()
    assert {tuple(r) for r in got} == brute({i: r.text for i, r in documents.items()}) and len(got) > 20


def test_units_are_lines_and_sentences():
    text = "One two three four five. Six seven eight nine ten!\nToo short.\nA single sentence of six words"
    assert [text[a:b] for a, b, _ in line_dedup.units(text)] == ["One two three four five.", "Six seven eight nine ten!", "One two three four five. Six seven eight nine ten!", "Too short.", "A single sentence of six words"]


def test_passage_inside_a_line_is_cut(spark):
    passage = " ".join(f"Here stands sentence number {k} of a passage." for k in range(8))
    rows = [(1, f"Alpha begins this text. {passage}"), (2, f"Quite another start of a line. {passage} And its own end of it all.")]
    got = {r.doc_id: r for r in line_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[1].removed is None
    assert got[2].text.split() == "Quite another start of a line. And its own end of it all.".split()
    assert all(rows[1][1][s.start : s.stop] in passage for s in got[2].removed)


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.start, r.keeper_id, r.keeper_start) for r in line_dedup.repeated_units(odd).collect()}
    assert (1, 0, 0, 0) in got and (9, 0, 8, 0) not in got and all(i not in (2, 3, 4, None) for i, *_ in got)
    assert line_dedup.repeated_units(none).collect() == []
    cut = line_dedup.cut_repeats(odd)
    assert cut.columns == [*odd.columns, "removed"] and cut.count() == 13


def removed(spark, rows):
    cut = line_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: [dict(rows)[r.doc_id][s.start : s.stop] for s in r.removed or []] for r in cut}


def test_short_lines_and_lines_without_spaces_are_units(spark):
    rows = [(1, "All rights reserved\nOnly here\n版权所有\n---"), (2, "all RIGHTS reserved.\nQuite other\n版权所有\n---")]
    assert removed(spark, rows) == {1: [], 2: ["all RIGHTS reserved.", "版权所有"]}


def test_short_sentences_go_between_repeated_neighbours(spark):
    first, last = "Here stands the first of the sentences.", "And here stands the last of them."
    rows = [(1, f"Start one. {first} Yes. So it is. {last} End one."), (2, f"Start two. {first} Yes. So it is. {last} End two."), (3, f"{first} No. So it is. {last} Start one. Else.")]
    assert removed(spark, rows) == {1: [], 2: [first, "Yes.", "So it is.", last], 3: [first, last]}


def test_sentences_of_a_line_without_spaces(spark):
    rows = [(1, "这是第一句话。中间一句不同的话。"), (2, "这是第一句话。这里说的是别的事情。")]
    assert removed(spark, rows) == {1: [], 2: ["这是第一句话。"]}


def test_long_runs_of_marks_end():
    import time

    began = time.time()
    for text in ("." * 300000, "a" + "?!" * 200000 + "b. " * 3, ". " * 100000):
        list(line_dedup.units(text))
    assert time.time() - began < 10
    assert [m for m in line_dedup._SENTENCE.findall("Yes... and no. End")] == ["Yes...", "and no.", "End"]

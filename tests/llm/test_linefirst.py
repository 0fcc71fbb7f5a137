"""Line-first rules against a plain Python reading of them."""

import re

from veristrata.llm import linefirst

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = linefirst.Rules()


def fails(line):
    t = line.strip(linefirst.BLANKS)
    n, found = len(WORD.findall(t)), set()
    if not t:
        return found
    ends = re.search(r"[.!?:;…。！？؟।][\"')\]”’\xBB]*$", t)
    bare = len("".join(WORD.findall(t)))
    if n < R.short and not ends or (m := sum(c in linefirst.MARKS for c in t)) > R.few and 100 * m > R.marks * bare:
        found.add("punctuation")
    bars = len(re.split(r" (?:\||>|/|\xBB|›|•|\xB7|::) ", t)) - 1
    if bars >= 2 and n <= R.items * bars or n <= R.label and any(re.match(p + r"([^a-z]|$)", t.lower()) for p in linefirst.NAVIGATION):
        found.add("navigation")
    if any(p in t.lower() for p in linefirst.BOILERPLATE):
        found.add("boilerplate")
    return found


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = text.split("\n")
    full = [x for x in lines if WORD.search(x)]
    kept = [x for x in lines if not fails(x)]
    chars = lambda s: len("".join(WORD.findall(s)))
    lost = chars(text) - chars("".join(kept))
    bad = len(words) < R.fewest or 100 * len(again) > R.repeated * len(words)
    return ("\n".join(kept), len(words), chars(text), sum(c in linefirst.SYMBOLS for c in text), len(full) - len(set(full)), len(again), lost, bad, not bad and 100 * lost <= R.lost * chars(text))


PROSE = "The old mill stood by the river, and nobody had worked in it for years."
LINES = {
    PROSE: set(), "Chapter one": {"punctuation"}, "He said so.": set(), "“Yes!”": set(), "": set(), " \t ": set(), "x | y | z and more": {"navigation"},
    "Home > Shop > Garden tools": {"navigation"}, "Hm... (!)": set(), "Read more about this.": {"navigation"}, "Readmore about this.": set(), "Homes are dear here.": set(),
    "© 2020 Example Inc. All rights reserved.": {"boilerplate"}, "We value your trust, and this site USES COOKIES to tell us who you are.": {"boilerplate"},
    "word### word&&& word$$$ word*** word%%% word### word&&&": {"punctuation"}, "She chose red / white over blue / green for the long winter evenings at home by the sea.": set(), "é è ê à ç ü ö": set(), "終わり。": set(), "終わり": {"punctuation"},
}


def test_lines(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    f = linefirst.failures(df["line"])
    got = {r[0]: {k for k in f if r[k]} for r in df.select("line", *[c.alias(k) for k, c in f.items()]).collect()}
    assert got == LINES == {x: fails(x) for x in LINES}


def test_measured(spark):
    """Nulls, blank texts, repeats that overlap, repeated rows, long texts, clashing columns."""
    eight = "one two three four five six seven eight"
    texts = [None, "", "\n \t", PROSE, f"{PROSE}\n" * 3, "a " * 40, "a " * 9, f"{eight} x {eight}", f"{eight} {eight} nine ten", "A " * 8 + "a " * 8, "\n".join(LINES), f"{PROSE} {PROSE[::-1]}.\nHome | About | Contact\n{PROSE.upper()}",
             "\x0b".join(f"w{i}" for i in range(30)) + " end.", "short\n" * 20, "ab  cd\r\nab  cd\r\n" * 20, "x" * 300_000, " ".join(f"w{i % 3000}" for i in range(7000)) + ".", f"{PROSE}\nmenu\n{PROSE.lower()}\n # # # \n" + " ".join(str(i) for i in range(50)) + "."]
    rows = [(i, t, "clash", True) for i, t in enumerate(texts)] + [(3, PROSE, "again", False), (None, "\n".join(LINES), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, clean_text string, kept boolean")
    out = linefirst.measured(df)
    got = sorted(tuple(r) for r in out.select("doc_id", *linefirst.MEASURES).fillna(-1, "doc_id").collect())
    assert got == sorted((-1 if d is None else d, *brute(t)) for d, t, *_ in rows)
    assert {r[-1] for r in got} == {True, False} and out.columns == ["doc_id", "text", *linefirst.MEASURES]
    assert out.filter("kept AND n_repeat_words >= 0").count() == sum(r[-1] for r in got)
    clean = linefirst.cleaned(df)
    assert clean.columns == df.columns and sorted(r["text"] for r in clean.collect()) == sorted(r[1] for r in got if r[-1])
    assert linefirst.measured(df.limit(0)).count() == 0


def test_plan(spark):
    """One projection: no shuffle, no Python, and a filter on the verdict doesn't repeat the work beneath it."""
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = linefirst.measured(df).filter("kept")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Pandas|Arrow", plan) and plan.count("array_distinct(_v") == 1

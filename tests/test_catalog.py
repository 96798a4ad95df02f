"""Every query against its DuckDB counterpart, and the entry module with and without the subpackage."""

import hashlib
import math
import os
import re
import subprocess
import sys
from difflib import SequenceMatcher
from pathlib import Path

import pandas as pd
import pytest

from quillgraph.plans.catalog import QUERIES, SQL

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(f"{v:.9g}")
    return plain(v.item()) if hasattr(v, "item") else v


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def letters(text):
    return re.findall("[a-z]+", text.lower())


class PlainNames:
    """Names and what they stand for, one after the other, as the three steps have it."""

    def __init__(self, duck):
        self.entries, names = {}, set()
        for remedy, seq in duck.execute("SELECT p_name, min(p_partkey) FROM part GROUP BY 1").fetchall():
            first, last = remedy.split(" ")
            self.entries[seq] = (remedy, [remedy, f"{first}-{last[:3]}"])
            names |= {remedy.upper() + ".", remedy + " (old form)", f"{first} {last[:2]}", remedy[:2] + "x" + remedy[3:]}
        self.names = sorted(names)

    def exact(self, name):
        whole = re.sub(r"\s*\([^)]*\)\s*", " ", name)
        for variant in [whole, *re.findall(r"\(([^)]*)\)", name)]:
            hits = [seq for seq, (_, known) in self.entries.items() for k in known if letters(k) == letters(variant) != []]
            if hits:
                return max(hits)
        return None

    def prefix(self, name):
        own = letters(name)
        if not own or len(own[0]) < 3:
            return None
        fits = {seq for seq, (_, known) in self.entries.items() for k in known if letters(k)[:1] == own[:1] and len(own) <= len(letters(k)) and all(b.startswith(a) for a, b in zip(own, letters(k)))}
        return fits.pop() if len(fits) == 1 else None

    def fuzzy(self, name, threshold=0.9, margin=0.05):
        key = " ".join(letters(name))
        if len(key) < 5:
            return None
        scores = sorted(((max(SequenceMatcher(None, key, " ".join(letters(k))).ratio() for k in known), -seq) for seq, (_, known) in self.entries.items()), reverse=True)
        return (-scores[0][1], scores[0][0]) if scores[0][0] >= threshold and scores[0][0] - scores[1][0] >= margin else None


def plain_alias_fuzzy(duck):
    p = PlainNames(duck)
    found = {n: p.fuzzy(n) for n in p.names}
    return [{"name": n, "canonical": p.entries[f[0]][0], "score": round(f[1], 6)} for n, f in found.items() if f]


def plain_alias_cascade(duck):
    p, out = PlainNames(duck), []
    for n in p.names:
        steps = {"exact": p.exact(n), "prefix": p.prefix(n), "fuzzy": (p.fuzzy(n) or [None])[0]}
        step = next((s for s, hit in steps.items() if hit is not None), None)
        out.append({"name": n, "canonical": p.entries[steps[step]][0] if step else None, "step": step})
    return out


def plain_alias_lookup(duck):
    p, out = PlainNames(duck), []
    for n in p.names:
        whole = max((seq for seq, (_, known) in p.entries.items() for k in known if letters(k) == letters(n)), default=None)
        steps = {"exact": whole, "prefix": p.prefix(n), "fuzzy": (p.fuzzy(n) or [None])[0]}
        step = next((s for s, hit in steps.items() if hit is not None), None)
        out.append({"name": n, "canonical": p.entries[steps[step]][0] if step else None, "step": step})
    return out


def plain_alias_feedback(duck):
    p, out = PlainNames(duck), []
    for n in p.names:
        hit = next((h for h in (p.exact(n), p.prefix(n), (p.fuzzy(n) or [None])[0]) if h is not None), None)
        if hit is not None:
            p.entries[hit][1].append(n)
        out.append({"name": n, "source": "names", "canonical": p.entries[hit][0] if hit is not None else None})
    return out


def plain_quote_fuzzy(duck):
    from quillgraph.operators.grounding import THRESHOLD

    texts, out = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall()), []
    for i, t in texts.items():
        of = i + (i % 3 == 0)
        if of in texts:
            q, s = (" ".join(x.lower().split()) for x in (t.split("\n")[0][10:50].replace(" ", "  "), texts[of]))
            found = bool(q and s) and q in s
            if q and s and not found:
                m = SequenceMatcher(None)
                m.set_seq1(q)
                for a in range(0, max(1, len(s) - len(q) + 1), max(1, len(q) // 4)):
                    m.set_seq2(s[a : a + len(q)])
                    if m.real_quick_ratio() >= THRESHOLD and m.quick_ratio() >= THRESHOLD and m.ratio() >= THRESHOLD:
                        found = True
                        break
            out.append({"doc_id": i, "quote_found": found})
    return out


def plain_mcq_draw(duck):
    from quillgraph.plans.catalog import REMEDY, SEED

    made = duck.execute(SQL["mcq_keynote"]).df()
    made = made[made.remedy == REMEDY]
    made["question"] = ['Which remedy is characterized by this keynote symptom: "' + q + '"?' for q in made.supporting_quote]
    one = min(made.itertuples(), key=lambda r: (hashlib.md5(f"keynote|{r.question}|{SEED}".encode()).hexdigest(), r.question))
    return [{"kind": "keynote", "question": one.question, "options": one.options, "correct_index": one.correct_index, "chunk_id": f"deterministic:store:{REMEDY} § Section {one.section_no}", "well_formed": True}]


#: What SQL does not state (matching blocks of strings, order-dependent builds), in plain Python.
PLAIN = {"alias_fuzzy": plain_alias_fuzzy, "alias_cascade": plain_alias_cascade, "alias_lookup": plain_alias_lookup, "alias_feedback": plain_alias_feedback, "quote_fuzzy": plain_quote_fuzzy, "mcq_draw": plain_mcq_draw}


def test_vector_index_search_finds_nine_tenths(spark, data, duck):
    got = {r.query_id: (r.ids.split(","), r.recall) for r in QUERIES["vector_index_search"](spark, data).collect()}
    right = {}
    for q, i in duck.execute(f"SELECT query_id, id FROM ({SQL['vector_index_exact']})").fetchall():
        right.setdefault(q, set()).add(str(i))
    assert got.keys() == right.keys()
    assert all(abs(len(right[q] & set(ids)) / len(right[q]) - recall) < 1e-9 for q, (ids, recall) in got.items())
    assert sum(r for _, r in got.values()) / len(got) >= 0.9


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - {"vector_index_search"}))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    want = duck.execute(SQL[name]).df() if name in SQL else pd.DataFrame(PLAIN[name](duck))
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_entry_module_without_a_session_or_the_subpackage(tmp_path):
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q))"
    run = lambda at: subprocess.run([sys.executable, "-c", code], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True, timeout=120)
    whole = run(ROOT)
    assert whole.returncode == 0, whole.stderr
    for p in ("__spark_entry__.py", "quillgraph"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    import shutil

    shutil.copytree(ROOT / "quillgraph", tmp_path / "quillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "__spark_entry__.py").unlink()
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    bare = run(tmp_path)
    assert bare.returncode == 0, bare.stderr
    assert int(bare.stdout) == len(QUERIES)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "quillgraph").rglob("*.py"):
        if "llm" not in p.parts:
            assert ".llm" not in p.read_text() and "import llm" not in p.read_text()

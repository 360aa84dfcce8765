"""Line dedup against plain counting."""

import time
from collections import Counter, defaultdict

from samples import frame

from provweave.llm import lines

SCHEMA = "page_id long, url string, html string, host string, hashes int, lines string"


def test_pages(spark):
    page = lambda i, host: (i, f"https://user@{host.upper()}:80/p/{i}?q", f"<HTML><head><style>p{{}}</style><title>T{i}</title></head><body><!-- x\n --><nav><a>Home</a></nav><p>own  text {i}</p><br/><div>Part {i % 3}</div><script>s()</script>© {host}</body>", "h", 1, "l")
    rows = [page(i, "a.org") for i in range(9)] + [page(20 + i, "b.org") for i in range(2)] + [(40, None, "<p>Home</p>", "h", 1, "l"), (41, "no url", None, "h", 1, "l"), (None, "http://a.org", "", "h", 1, "l")]
    rows += [rows[0], rows[0]]
    got = [tuple(r) for r in lines.clean_pages(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    texts = {r[0]: r for r in got}
    assert texts[1] == (1, "a.org", 5, 2, "T1\nown text 1\nPart 1") and texts[3] == (3, "a.org", 5, 3, "T3\nown text 3")
    assert texts[20] == (20, "b.org", 5, 0, "T20\nHome\nown text 20\nPart 2\n© b.org") and texts[40] == (40, None, 1, 0, "Home") and texts[41] == (41, None, 0, 0, "") and texts[None] == (None, "a.org", 0, 0, "")


def test_malformed_pages(spark):
    odd = {"<p>a<script>b<p>c": "a", "a<!-- b <p>c": "a", "a<p <p>b</p": "a<p\nb</p", "1 < 2 > 0 <b": "1 0 <b", "<style x": "", "<SCRIPT a='>'>x</Script>y": "y", "a<!--b-->c<!-->d": "a c"}
    rows = [(i, "http://a.org", h, "h", 1, "l") for i, h in enumerate(odd)]
    got = {r["page_id"]: r["text"] for r in lines.clean_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(odd))] == list(odd.values())


def test_long_malformed_pages_take_linear_time(spark):
    rows = [(i, "http://a.org", h, "h", 1, "l") for i, h in enumerate(["<script" * 100_000, "<script>" * 100_000, "<!--" * 100_000, "<" * 400_000, "<p " * 200_000, "</" * 200_000, "<p>x" * 100_000, " " * 400_000])]
    began = time.time()
    got = {r["page_id"]: r["n_lines"] for r in lines.clean_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[6] == 100_000 and got[7] == 0 and time.time() - began < 60


def test_documents_by_source(spark, no_docs):
    rows = [(i, f"first {i}\n\n All rights reserved.\nrare {i % 9}\nlast {i}", "en", ["a", "b", None][i % 3]) for i in range(60)] + [(90, None, "en", "a"), (91, "", "en", "a"), (92, "All rights reserved.", "en", "a")]
    got = lines.drop_boilerplate(frame(spark, rows), "source", 0.5, 3)
    assert got.columns == frame(spark, rows).columns
    found = {r["doc_id"]: r["text"] for r in got.collect()}
    seen, total = defaultdict(Counter), Counter(r[3] for r in rows)
    for _, t, _, s in rows:
        seen[s].update({x for x in (t or "").split("\n") if x.strip()})
    for i, t, _, s in rows:
        kept = t if t is None or s is None else "\n".join(x for x in t.split("\n") if not (seen[s][x] >= 3 and seen[s][x] > 0.5 * total[s]))
        assert found[i] == kept
    assert found[92] == "All rights reserved." or found[92] == ""
    assert lines.drop_boilerplate(no_docs, "source", 0.5, 3).count() == 0
    assert lines.clean_pages(spark.createDataFrame([], SCHEMA)).count() == 0

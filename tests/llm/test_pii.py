"""Personal data, against the plain patterns."""

import hashlib
import re

import pyarrow.dataset as ds
from pyspark.sql import functions as F

from quernel.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SF = "/root/testdata/sf0.01"
HARD = [
    None, "", "a@b.com_x@c.com", "..a@b..c d@e.f.g@h.i", "é é x@y.zz 1.2.3.4.5.6.7.8 256.1.1.1 01.002.255.0", "1.2.3 4.5.6.7.", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4" * 16 + " 0000 0000 0000 0000 0", "7" * 3000, "+1 (555) 555-0100, +1 2 +1234567 +12345678 +1234567890123456", "+1 555 555 0100 4111111111111111", "@ @a.b a@b a@.c", "🙂 a.b+c@d-e.f 🙂 10.0.0.1",
    "call (555) 555-0142 or write to ann [at] mail [dot] example", "x" * 5000, "1.1.1.1" * 50, "4111111111111111x" * 30,
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        if {"email": "@", "ip": "."}.get(kind, "") not in (text or ""):  # Python would try a long run from each place
            continue
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def checked(rows, texts):
    added = 0
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS], texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert {*want} <= {*spans} and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        added += len(spans) - len(want)
    return added


def test_base_spans_on_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()}
    rows = queries.op8_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    assert checked(rows, texts) <= 5  # the documents' personal data is of the strict forms


def test_base_spans_hard(spark, tmp_path):
    spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op8_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(HARD)
    assert checked(rows, HARD) >= 2
    docs = spark.createDataFrame([(1, "call (555) 555-0142 or mail a@b.cc!"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == ["call [phone] or mail [email]!", ""]
    assert pii.find(docs.limit(0)).count() == 0


def test_long_runs(spark):
    """Runs of very many labels, octets, digits and addresses in one text."""
    n = 300_000
    texts = ["a@b" + ".c" * n, "1" + ".1" * n, "4" * n, "4 " * n, "a [at] b" + " [dot] c" * n, "ann@mail.example " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find(docs).select("doc_id", pii.listed(F.col("base")).alias("base")).collect()}
    for i, t in enumerate(texts):
        assert rows[i]["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in base(t))


def test_own_columns(spark):
    docs = spark.createDataFrame([("mail a@b.cc", 1, 2)], "text string, spans int, base int")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [("mail [email]", 1, 2)]

import hashlib
import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from lodestone.llm import pii

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    out = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(RAW.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [x[2] for x in sorted(out)]


TEXTS = [
    None, "", "nothing here", "a@b.com_x@y.com a@@b.c é😀 und.34@mail7.example.com.",
    "ip 1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4 1.2.3 999.1.2.3.4 99999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 1234567812345670 79927398713 5555555555554444 378282246310005",
    "+1 (017) 555-7713 +49 30 1234567. + 1 +1+2 +33(((((( +1 4111 1111 1111 1111 +123456789012345678",
    "1 " * 3000 + "a" * 20000 + "@" + "+1" * 500, "9" * 20000, "a.b@c.d" * 400,
    "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 but DE88 3704 0044 0532 0130 00",
    "my ssn 123-45-6789 and 123-45-6789 elsewhere, far from any such word at all here 123-45-6788", 'token = "0123456789abcdef" Ḁ 10.0.0.1',
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_base_spans_equal_brute_force(spark, tmp_path):
    rows(spark, TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op9_pii_spans(spark, str(tmp_path)).collect():
        want = brute(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), TEXTS[r.doc_id][:60]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in RAW] == want
        assert r.n_email == sum(s.startswith("email") for s in want)


def test_extra_kinds_need_checksum_or_context(spark):
    got = {r.doc_id: r.s for r in pii.find_pii(rows(spark, TEXTS)).select("doc_id", pii._listed(F.col("pii")).alias("s")).collect()}
    assert re.findall(r"iban:\d+:\d+", got[10]) == ["iban:0:27", "iban:32:54"]
    assert re.findall(r"ssn:\d+:\d+", got[11]) == ["ssn:7:18"]
    assert "secret:0:26" in got[12] and "ip:29:37" in got[12]


def test_mask(spark):
    got = [r.text for r in pii.mask_pii(rows(spark, ["x a@b.c y", None, "", "+1 4111 111 1111 a@1.2.3.4 é!"]).withColumn("pii", F.lit(1))).orderBy("doc_id").collect()]
    assert got == ["x [EMAIL] y", None, "", "[PHONE] [EMAIL] é!"]


def test_empty_table(spark):
    assert pii.find_pii(rows(spark, ["a"]).limit(0)).count() == 0


def test_query_equals_sql(spark, tmp_path):
    texts = TEXTS + ['my SSN 123-45-6789 apiKey="abcdefgh12" xtoken = "abcdefghij" _DE89370400440532013000', "GB82 WEST 1234 5698 7654 32é 1.2.3.004 0256.1.1.1"]
    rows(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        files = f"{folder}/documents.parquet" + ("/*.parquet" if folder == str(tmp_path) else "")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
        want = con.sql(pii.OP9_SQL).df().sort_values("doc_id").reset_index(drop=True)
        got = pii.op9_pii_spans(spark, folder).toPandas().sort_values("doc_id").reset_index(drop=True)
        assert len(got) == len(want) and got.astype(str).equals(want[list(got.columns)].astype(str)), got.astype(str).compare(want[list(got.columns)].astype(str))


def test_clashing_columns_repeated_rows_and_long_secrets(spark):
    long = 'token = "' + "a1" * 3000 + '" and mail x@y.zz'
    df = spark.createDataFrame([(1, long, 7)] * 3 + [(2, None, 7)], "doc_id long, text string, pii int")
    found = pii.find_pii(df)
    assert found.columns == ["doc_id", "text", "pii", "_pii"] and found.where("pii = 7").count() == 4
    assert [[s.kind for s in r._pii or []] for r in found.orderBy("doc_id").collect()] == [["secret", "email"]] * 3 + [[]]
    masked = pii.mask_pii(df).orderBy("doc_id").collect()
    assert [r.text for r in masked] == ["[SECRET] and mail [EMAIL]"] * 3 + [None] and {r.pii for r in masked} == {7}


def test_context_on_either_side(spark, tmp_path):
    texts = ["123-45-6789 (SSN)", "234-56-7890 and then, a long way behind it, comes ssn", "1 social\nsecurity 123-45-6789", "é 123-45-6789: his Social Security number", "000-45-6789 ssn"]
    rows(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.spans for r in pii.op9_pii_spans(spark, str(tmp_path)).collect()}
    assert got == {0: "ssn:0:11", 1: "", 2: "", 3: "ssn:2:13", 4: ""}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.sql(f"SELECT doc_id, spans FROM ({pii.OP9_SQL})").fetchall()) == got


def test_running_sums_and_maxima(spark):
    rng = random.Random(3)
    lists = [[rng.randint(0, 50) for _ in range(n)] for n in (0, 1, 2, 3, 10, 57, 400)] + [None]
    df = spark.createDataFrame([(x,) for x in lists], "xs array<int>")
    got = df.select("xs", pii.running(F.col("xs"), lambda a, b: a + b).alias("s"), pii.running(F.col("xs"), F.greatest).alias("m")).collect()
    for r in got:
        xs = r.xs or []
        assert (r.s or []) == [sum(xs[:i]) for i in range(len(xs))] and (r.m or []) == [max(xs[:i], default=0) for i in range(len(xs))]


def masked(text, spans):
    """Spans by start; one that begins inside those before it joins them."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def test_mask_of_texts_longer_than_a_piece(spark):
    rng = random.Random(7)
    parts = ["1.2.3.4", "+1 4111 1111 1111 1111", "a.b@1.2.3.4.com", "é😀", " ", "words and more words ", "\n\n", "x" * 5000, "4111111111111111", "DE89370400440532013000 "]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (3, 30, 300, 1500)] + ["1.2.3.4" + "y" * 4089, "y" * 4096 + "1.2.3.4", "z" * 4090 + " 1.2.3.4 " + "z" * 8192 + "1.2.3.4"]
    df = rows(spark, texts)
    found = {r.doc_id: r.pii for r in pii.find_pii(df).collect()}
    for r in pii.mask_pii(df).collect():
        assert r.text == masked(texts[r.doc_id], found[r.doc_id])


def test_a_megabyte_of_addresses(spark):
    text = "1.2.3.4 some words here " * 43_700
    df = rows(spark, [text])
    began = time.perf_counter()
    (n,) = df.transform(pii.find_pii).select(F.size("pii")).first()
    (out,) = pii.mask_pii(df).select("text").first()
    assert n == 43_700 and out == "[IP] some words here " * 43_700
    assert time.perf_counter() - began < 20

import hashlib
import random
import re

from pyspark.sql import functions as F

from postrank.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and sum(
                    sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


def base(found):
    return pii.listed([x for x in found if x.kind < len(pii.BASE)])


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(5)
    bits = ["a@b.c", "_d@e.f", "@", ".", "..", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", " ",
            "+1 (555) 123-4567", "+49", "-", "x", "é", "12", "0", "%+", "\n", "+1     ", "5500005555555559", ")", "b@c"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert base(pii.spans(text)) == plain(text), text


def test_long_runs_are_scanned_in_linear_time():
    for text in ("a" * 10**6, "078-05-1120 " * 50_000, "1" * 10**6, "1.x" * 300_000, "+1" + " " * 10**6, "a@" * 300_000, "+1" * 300_000):
        assert pii.spans(text) == []


def test_added_kinds_need_checksum_or_context():
    assert pii.listed(pii.spans("pay to bank account GB82 WEST 1234 5698 7654 32 now")).startswith("iban:20:47")
    assert pii.spans("GB83 WEST 1234 5698 7654 32") == []
    assert pii.listed(pii.spans("ssn 078-05-1120")) == "ssn:4:15"
    assert pii.spans("part 078-05-1120") == []


def test_query_columns_on_edge_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "mail a@b.co, é +1 555 123 4567"), (3, "mail a@b.co, é +1 555 123 4567"), (None, "x")])
    got = pii.find(docs.withColumn("spans", F.lit("clash")), redact=True).orderBy("doc_id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [r["base_sha256"] == empty for r in got] == [True, True, True, False, False]
    assert got[3]["spans"] == "email:5:11,phone:15:30" and got[3]["n_phone"] == 1
    assert got[3]["text"] == "mail [EMAIL], é [PHONE]" and got[1]["text"] is None
    assert pii.find(docs.limit(0)).count() == 0

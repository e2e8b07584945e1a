"""The personal-data field leaves ordinary words and figures alone."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import pii

TABLE = "/root/testdata/sf0.01/documents.parquet"
PLAIN = [
    " ".join(f"word{k}" for k in range(20_000)), "word1000 word10000", "gpt4567 x1234 a12345", "2011 2012 2013 2014 2015 2016", "2019 2020 2021", "1 234 567 890 people", "ISBN 978-0-306-40615-7 of this book",
    "ISBN 9780306406157", "version 1.2.3 and v10.4", "Q3 2016 rose 2.5 to 1,234,567", "10 20 30 40 50 60 70", "table 1 12 123 1234 12345", "In 1999, 2000 and 2001, 45 of 67", "model b52 and mp3 files, h264",
    "chapter 12 verse 14, pages 123-145", "room 1204, 3rd floor, flat 22b", "Des. " * 300, "Enèé. " * 300, "Sur, " * 300,
]
PRIVATE = [
    "call 555-123-4567 now", "tel. (212) 555-0199 or", "phone: 415 555 2671 today", "password: Hunter2019! ok", "api_key=9f86d081884c7d659a2feaa0c55ad015", "card 4111 1111 1111 1112 expires 09/27",
    "card number: 5500-0000-0000-0004", "server 10.0.0.1:8080 is down", "mail é@ü.es please",
]


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_words_and_figures_have_no_spans(field):
    assert [t[:40] for t, s in zip(PLAIN, pii.spans(pa.array(PLAIN), field)) if s] == []
    assert [t for t, s in zip(PRIVATE, pii.spans(pa.array(PRIVATE), field)) if not s] == []


@pytest.mark.skipif(not os.path.isfile(TABLE), reason="needs the driver's tables")
def test_added_spans_are_rare_and_hold_digits(field):
    texts = pq.read_table(TABLE, columns=["text"])["text"].combine_chunks()
    added = [t.as_py()[a:b] for t, s in zip(texts, pii.spans(texts, field)) for _, a, b, base in s if not base]
    words = sum(len(t.as_py().split()) for t in texts if t.as_py())
    assert all(any(ch.isdigit() for ch in x) for x in added) and 10_000 * len(added) < words

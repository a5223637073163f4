import csv
import datetime
import io
import random
import re

from quire.sources.delimited import FIELDS, parse_records, rejects, valid

GOOD = ["0123456789abcde", "Ann", "Lee", "Co, Ltd", "X", "Y", "1", "", "a.b@c.de", "2024-02-29", "https://c.de:80/x"]


def brute(line, sep):
    line, sep = line or "", sep if sep and len(sep) == 1 and ord(sep) < 128 else ","
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(line):
                    return "quoting", None
                if line[i] == '"' and line[i + 1 : i + 2] == '"':
                    text, i = text + '"', i + 2
                elif line[i] == '"':
                    i += 1
                    break
                else:
                    text, i = text + line[i], i + 1
            if i < len(line) and line[i] != sep:
                return "quoting", None
        else:
            j = line.find(sep, i)
            text = line[i:] if j < 0 else line[i:j]
            if '"' in text:
                return "quoting", None
            i += len(text)
        fields.append(text)
        if i >= len(line):
            break
        i += 1
    if len(fields) != 11:
        return "columns", None
    v = [f.strip() for f in fields]
    host = r"[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+"
    if not re.fullmatch("[0-9a-fA-F]{15}", v[0]):
        return "id", None
    if v[8] and not re.fullmatch(r"[A-Za-z0-9_+-]+(\.[A-Za-z0-9_+-]+)*@" + host, v[8]):
        return "email", None
    try:
        if v[9]:
            assert re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", v[9])
            datetime.date.fromisoformat(v[9])
    except (AssertionError, ValueError):
        return "subsdate", None
    if v[10] and not re.fullmatch("https?://" + host + r"(:[0-9]{1,5})?([/?#]\S*)?", v[10]):
        return "website", None
    return None, fields


def test_random_records(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(3000):
        sep = rnd.choice([",", ";", "\t", "|", None, "", "::", "é"])
        s = sep if sep and len(sep) == 1 and ord(sep) < 128 else ","
        f = list(GOOD)
        if rnd.random() < 0.4:
            f[rnd.randrange(11)] = rnd.choice(["", " x ", "a@b", 'say "hi"', "é\n" + s, "2023-02-30", "http://a..b", "0000-01-01", "http://a.b:123456", " 2024-01-01 ", "HTTP://a.b"])
        if rnd.random() < 0.1:
            f = f[: rnd.randrange(1, 11)] if rnd.random() < 0.5 else [*f, ""]
        out = io.StringIO()
        csv.writer(out, delimiter=s, quoting=rnd.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]), lineterminator="").writerow(f)
        line = out.getvalue()
        for _ in range(rnd.choice([0, 0, 0, 1, 2])):
            i = rnd.randrange(len(line) + 1)
            line = line[:i] + rnd.choice(['"', '""', s, "", '" ']) + line[i + rnd.choice([0, 1]) :]
        rows.append((k, line, sep, "clash"))
    rows += [(-1, None, ",", None), (-2, "", ",", None), (-3, '""', ",", None), (-4, ",".join(["x" * 200_000] * 11), ",", None), (-5, ",".join(GOOD[:3] + ['"Co, Ltd"'] + GOOD[4:]), None, None)] * 2
    df = spark.createDataFrame(rows, "line_no long, raw_line string, sep_char string, reason string")
    got = parse_records(df).collect()
    assert len(got) == len(rows)
    want = {r[0]: brute(r[1], r[2]) for r in rows}
    for r in got:
        reason, fields = want[r.line_no]
        assert r.reason == reason, (r, want[r.line_no])
        assert [r[c] for c in FIELDS] == (fields or [None] * 11)
    assert rejects(df).count() + valid(df).count() == len(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_no long, raw_line string, sep_char string")
    assert parse_records(df).collect() == []

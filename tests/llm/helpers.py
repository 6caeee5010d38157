"""Plain versions of the word rules, for brute-force checks."""

import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SF = "/root/testdata/sf0.001"


def spaced(text):
    return SPACED.findall((text or "").translate(LOWER))


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def texts(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)

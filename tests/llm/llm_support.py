"""Helpers of the tests in this folder."""

SF_DIR = "/root/testdata/sf0.001"


def by_id(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}

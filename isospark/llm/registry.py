"""All queries of the training-data operators, and their SQL where it can express them."""

from . import bpe, collocations, decontam, itq, lexical, licenses, pii, repeats, simhash, tokens, topk, toxicity, urls

MODULES = (bpe, simhash, licenses, repeats, toxicity, tokens, topk, pii, decontam, urls, lexical, collocations, itq)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}

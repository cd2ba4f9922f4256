"""Every registered query of this folder with its check SQL (None where SQL cannot express it)."""

from __future__ import annotations

from txnguard.llm import q_bpe, q_langid, q_licenses, q_mixing, q_packing, q_pii, q_rabitq, q_simhash, q_suffixes, q_trie, q_warc, q_whitening, q_winnowing

MODULES = (
    q_langid, q_licenses, q_mixing, q_packing, q_pii, q_rabitq, q_simhash, q_suffixes, q_warc, q_winnowing, q_trie, q_whitening, q_bpe,
)


def catalog() -> dict:
    return {name: entry for module in MODULES for name, entry in module.QUERIES.items()}

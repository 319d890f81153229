"""Queries of the numbered operators over the documents, embeddings and benchmark tables."""

from __future__ import annotations

from tidewire.llm import bpe, decontaminate, extract, language, minhash, pii, runs, substring_dedup, suffix_dedup, token_files, topk, toxicity, trie


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_minhash": minhash.op3_minhash,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_token_files": token_files.op5_token_files,
        "op6_surrogates": pii.op6_surrogates,
        "op7_bpe": bpe.op7_bpe,
        "op8_topk": topk.op8_topk,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_language": language.op10_language,
        "op11_periodic_runs": runs.op11_periodic_runs,
        "op12_prefix_trie": trie.op12_prefix_trie,
        "op13_html_text": extract.op13_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_topk": topk.OP8_SQL, "op12_prefix_trie": trie.OP12_SQL}

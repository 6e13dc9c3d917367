"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe_prefix, fill_in_middle, flow_reshard, fst_sentencepiece, hilbert_pack, kneser_ney, lz_fingerprint, merkle_manifest, pruned_graph_ann, simhash_tiles, skip_chain_pii, tag_path_html, warc_zip

QUERIES = {
    "op1_pruned_graph_ann": pruned_graph_ann.op1_pruned_graph_ann,
    "op2_warc_zip": warc_zip.op2_warc_zip,
    "op3_hilbert_pack": hilbert_pack.op3_hilbert_pack,
    "op4_simhash_tiles": simhash_tiles.op4_simhash_tiles,
    "op5_tag_path_html": tag_path_html.op5_tag_path_html,
    "op6_fst_sentencepiece": fst_sentencepiece.op6_fst_sentencepiece,
    "op7_skip_chain_pii": skip_chain_pii.op7_skip_chain_pii,
    "op8_kneser_ney": kneser_ney.op8_kneser_ney,
    "op9_flow_reshard": flow_reshard.op9_flow_reshard,
    "op10_lz_fingerprint": lz_fingerprint.op10_lz_fingerprint,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_bpe_prefix": bpe_prefix.op13_bpe_prefix,
}
SQL: dict[str, str] = {"op2_warc_zip": warc_zip.OP2_SQL, "op11_merkle_manifest": merkle_manifest.OP11_SQL, "op12_fill_in_middle": fill_in_middle.OP12_SQL}

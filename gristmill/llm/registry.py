"""The operators' queries and their SQL."""

from gristmill.llm import collocations, edit_counts, first_fit, html_text, jaccard_join, media, mixing, neighbours, packing, secrets, toxicity, url_filter, whitening

QUERIES = {
    f.__name__: f
    for f in (
        url_filter.op1_url_filter,
        toxicity.op2_toxicity,
        html_text.op3_html_text,
        packing.op4_best_fit_packing,
        mixing.op5_mixing,
        media.op6_media_columns,
        edit_counts.op7_edit_aware_counts,
        neighbours.op8_nearest_neighbours,
        secrets.op9_secret_scan,
        jaccard_join.op10_jaccard_join,
        first_fit.op11_first_fit_packing,
        whitening.op12_embedding_whitening,
        collocations.op13_phrase_collocations,
    )
}
ORACLE_SQL = {"op5_mixing": mixing.OP5_SQL, "op10_jaccard_join": jaccard_join.OP10_SQL, "op13_phrase_collocations": collocations.OP13_SQL}

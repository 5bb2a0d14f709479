"""The queries of this subpackage and their SQL."""

from corpuskit.llm import abuse, bpe, lang, mix, overlap, pieces, privacy, sample, unify, votes

QUERIES = {
    f.__name__: f
    for f in (
        abuse.p2_found, abuse.p2_scores, abuse.p2_rates, overlap.p1_found, overlap.p1_coverage, overlap.p1_rates, lang.p4_found, lang.p4_units, votes.p3_found, votes.p3_units, votes.p3_consensus, votes.p3_reliability, votes.p3_agreement, privacy.p6_found, privacy.p6_texts, privacy.p6_links,
        sample.p5_found, sample.p5_sample, sample.p5_report, unify.p7_found, unify.p7_forms, bpe.p8_ids, bpe.p8_token_counts,
        mix.p9_found, mix.p9_mixture, mix.p9_report, pieces.p10_found, pieces.p10_pieces,
    )
}
SQL = sample.SQL | unify.SQL | votes.SQL

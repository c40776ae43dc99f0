from pyspark.sql import functions as F

from gleaner.llm import quality_rules


def test_the_stage_applies_a_policy_to_failure_bits(edge, monkeypatch):
    asked, apply = [], quality_rules.fails

    def fails(policy, failures=None):
        asked.append((policy, failures is not None))
        return apply(policy, failures)

    monkeypatch.setattr(quality_rules, "fails", fails)
    few = quality_rules.Policy("few", 1, ("few_words",))
    for policy in (few, quality_rules.Policy("none", 1, ()), quality_rules.BASE):
        kept = sorted(str(r.doc_id) for r in quality_rules.kept_rows(edge, policy).collect())
        wanted = quality_rules.ledger(edge).filter(F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0)
        assert kept == sorted(str(r.doc_id) for r in wanted.collect())
        assert asked.pop() == (policy, True)


def test_ablation_columns_count_documents_that_fail_one_rule(spark, edge):
    rows = quality_rules.stored_ledger(edge)
    found = quality_rules.with_ablation(rows, quality_rules.STANDARD).collect()
    names = {1 << rule.bit: rule.name for rule in quality_rules.RULES}
    alone = [names[r.failures] for r in found if r.failures in names]
    assert len(found) == edge.count() and alone
    for r in found:
        assert (r.sole_rule, r.sole_docs) == ((names[r.failures], alone.count(names[r.failures])) if r.failures in names else (None, None))
    assert quality_rules.with_ablation(rows.limit(0), quality_rules.STANDARD).count() == 0

"""Named queries over the test tables: ``QUERIES[name](spark, sf_dir)``.

Every query reads the given tables (or data Spark derives from them) in
full; none uses id subsets or row caps.  Limits appear only where top-k is
the feature itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import features as feat
from ..sources import domain
from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


def fm_of(t: Tables) -> DataFrame:
    """F1 over the one-pass ledger (a single lineitem scan)."""
    return feat.finish_features(domain.ledger_features(t))


def plf_of(t: Tables) -> DataFrame:
    """The P&L with month-over-month changes and the stress label."""
    return feat.pl_features(domain.monthly_pl(t))


# ---------------------------------------------------------------- sources
@query("monthly_pl")
def q_monthly_pl(spark, sf_dir):
    return domain.monthly_pl(_t(spark, sf_dir))


@query("monthly_sales")
def q_monthly_sales(spark, sf_dir):
    return domain.monthly_sales(_t(spark, sf_dir))


@query("party_balances")
def q_party_balances(spark, sf_dir):
    return domain.party_balances(_t(spark, sf_dir))


@query("wastage")
def q_wastage(spark, sf_dir):
    return domain.wastage(_t(spark, sf_dir))


@query("category_sales")
def q_category_sales(spark, sf_dir):
    return domain.category_sales(_t(spark, sf_dir))


@query("daily_sales")
def q_daily_sales(spark, sf_dir):
    return domain.daily_sales(_t(spark, sf_dir))


@query("daily_dropped")
def q_daily_dropped(spark, sf_dir):
    """How many outlet days the daily filters leave out."""
    return domain.daily_dropped(_t(spark, sf_dir))


# ---------------------------------------------------------------- features
@query("feature_matrix")
def q_feature_matrix(spark, sf_dir):
    return fm_of(_t(spark, sf_dir))


@query("stress_label")
def q_stress_label(spark, sf_dir):
    return plf_of(_t(spark, sf_dir)).select("entity", "period", "profit_margin", "cogs_ratio",
                                            "margin_pressure", "stress")


@query("mom_change")
def q_mom_change(spark, sf_dir):
    return feat.mom_change(domain.monthly_pl(_t(spark, sf_dir))).select(
        "entity", "period", "sales_mom_pct", "cogs_mom_pct", "profit_mom_pct", "margin_pressure")


@query("party_totals")
def q_party_totals(spark, sf_dir):
    return feat.party_totals(domain.party_balances(_t(spark, sf_dir)))


@query("wastage_totals")
def q_wastage_totals(spark, sf_dir):
    return feat.wastage_totals(domain.wastage(_t(spark, sf_dir)))


@query("fill_totals")
def q_fill_totals(spark, sf_dir):
    return fm_of(_t(spark, sf_dir)).select("entity", "period", *feat.FILLED_TOTALS)


# ---------------------------------------------------------------- descriptive
from ..operators import descriptive as desc  # noqa: E402
from ..operators import diagnostic as diag  # noqa: E402
from ..operators import predictive as pred  # noqa: E402
from ..operators import prescriptive as presc  # noqa: E402
from ..operators import quality as dq  # noqa: E402


@query("kpi_change")
def q_kpi_change(spark, sf_dir):
    return desc.kpi_change(fm_of(_t(spark, sf_dir)))


@query("channel_mix")
def q_channel_mix(spark, sf_dir):
    return desc.channel_mix(domain.monthly_sales(_t(spark, sf_dir)))


@query("sales_trend")
def q_sales_trend(spark, sf_dir):
    return desc.sales_trend(domain.monthly_sales(_t(spark, sf_dir)))


@query("describe_pl")
def q_describe_pl(spark, sf_dir):
    return desc.describe(domain.monthly_pl(_t(spark, sf_dir)), desc.DESCRIBE_PL)


@query("describe_daily")
def q_describe_daily(spark, sf_dir):
    return desc.describe(domain.daily_sales(_t(spark, sf_dir)), desc.DESCRIBE_DAILY)


@query("describe_features")
def q_describe_features(spark, sf_dir):
    return desc.describe(fm_of(_t(spark, sf_dir)), desc.DESCRIBE_FEATURES)


@query("sales_volatility")
def q_sales_volatility(spark, sf_dir):
    return desc.sales_volatility(desc.sales_trend(domain.monthly_sales(_t(spark, sf_dir))))


@query("daily_volatility")
def q_daily_volatility(spark, sf_dir):
    return desc.daily_volatility(domain.daily_sales(_t(spark, sf_dir)))


@query("dow_seasonality")
def q_dow_seasonality(spark, sf_dir):
    return desc.dow_seasonality(domain.daily_sales(_t(spark, sf_dir)))


@query("stockout_proxy")
def q_stockout_proxy(spark, sf_dir):
    return desc.stockout_proxy(domain.category_sales(_t(spark, sf_dir)))


# ---------------------------------------------------------------- quality
def _dq_inputs(t):
    pl, ms, daily, parties = (domain.monthly_pl(t), domain.monthly_sales(t), domain.daily_sales(t),
                              domain.party_balances(t))
    return pl, daily, dq.quality_inputs(ms, pl, daily, parties)


@query("source_coverage")
def q_source_coverage(spark, sf_dir):
    return dq.source_coverage(domain.monthly_pl(_t(spark, sf_dir)))


@query("dq_completeness")
def q_dq_completeness(spark, sf_dir):
    _, _, ds = _dq_inputs(_t(spark, sf_dir))
    return dq.completeness(ds)


@query("dq_issues")
def q_dq_issues(spark, sf_dir):
    pl, daily, ds = _dq_inputs(_t(spark, sf_dir))
    return dq.issues(ds, pl, daily)


@query("dq_summary")
def q_dq_summary(spark, sf_dir):
    pl, daily, ds = _dq_inputs(_t(spark, sf_dir))
    return dq.summary_line(pl, daily, dq.issues(ds, pl, daily))


# ---------------------------------------------------------------- diagnostic
@query("variance_decomposition")
def q_variance_decomposition(spark, sf_dir):
    return diag.variance_decomposition(plf_of(_t(spark, sf_dir)))


@query("cost_elasticity")
def q_cost_elasticity(spark, sf_dir):
    return diag.cost_elasticity(domain.monthly_pl(_t(spark, sf_dir)))


@query("granger_lag1")
def q_granger_lag1(spark, sf_dir):
    return diag.granger_lag1(plf_of(_t(spark, sf_dir)))


@query("root_cause_notes")
def q_root_cause_notes(spark, sf_dir):
    t = _t(spark, sf_dir)
    return diag.root_cause_notes(plf_of(t), diag.cost_elasticity(domain.monthly_pl(t)),
                                 domain.party_balances(t))


# ---------------------------------------------------------------- predictive
@query("daily_features")
def q_daily_features(spark, sf_dir):
    return pred.daily_features(domain.daily_sales(_t(spark, sf_dir))).select(
        "entity", "date", "total_sales", *pred.DAILY_FEATURES)


@query("forecast_daily")
def q_forecast_daily(spark, sf_dir):
    return pred.forecast_daily(domain.daily_sales(_t(spark, sf_dir)))


@query("forecast_daily_sim")
def q_forecast_daily_sim(spark, sf_dir):
    return pred.forecast_daily_sim(domain.daily_sales(_t(spark, sf_dir)))


# ---------------------------------------------------------------- prescriptive
def supplier_alternatives(t: Tables) -> DataFrame:
    """Alternatives for TOPSIS: one per supplier, criteria from its whole
    history.  All criteria are ratios of integer-unit sums, so one
    aggregation over the joined lines gives exactly the totals of the
    monthly P&L and sales tables (one lineitem pass instead of two)."""
    from pyspark.sql import functions as F
    from ..functions.money import cents, units
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "l_discount", "l_tax")
    part = t.part.select("p_partkey", "p_retailprice")
    od = t.orders.select("o_orderkey", "o_orderpriority")
    j = li.join(part, li.l_partkey == part.p_partkey).join(od, li.l_orderkey == od.o_orderkey)
    ext, tax, disc = cents("l_extendedprice"), cents("l_tax"), cents("l_discount")
    zero = F.lit(0).cast("bigint")
    net = ext * (F.lit(100) - disc)
    g = j.groupBy(F.col("l_suppkey").alias("entity")).agg(
        F.sum(ext).alias("ext2"), F.sum(ext * tax).alias("tax4"),
        F.sum(units("l_quantity") * cents("p_retailprice")).alias("cogs2"),
        F.sum(F.when(F.col("l_linenumber").isin(1, 7), ext).otherwise(zero)).alias("opsal2"),
        F.sum(ext * disc).alias("fee4"), F.sum(net).alias("net4"),
        F.sum(F.when(F.col("o_orderpriority") == domain.CHANNELS["cash"], net).otherwise(zero)).alias("cash4"))
    inc4 = F.col("ext2") * 100 + F.col("tax4")
    profit4 = inc4 - F.col("cogs2") * 100 - F.col("opsal2") * 100 - F.col("fee4")
    s = t.supplier.select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("feasibility"))
    return g.join(s, "entity").select(
        "entity",
        F.try_divide(F.col("cash4").cast("double"), F.col("net4").cast("double")).alias("liquidity"),
        F.try_divide(profit4.cast("double"), inc4.cast("double")).alias("profitability"),
        "feasibility",
        (F.lit(1.0) - F.try_divide((F.col("cogs2") * 100).cast("double"), inc4.cast("double"))).alias("risk_reduction"))


@query("topsis_rank")
def q_topsis_rank(spark, sf_dir):
    return presc.topsis(supplier_alternatives(_t(spark, sf_dir)))


# ---------------------------------------------------------------- text + retrieval
from pyspark.sql import functions as F  # noqa: E402

from ..functions import text as tx  # noqa: E402
from ..operators import chunking as ch  # noqa: E402
from ..operators import retrieval as rt  # noqa: E402


def proposal_chunks(t: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Chunks of the cleaned documents (of those in ``wanted``, if given) with chunk metadata."""
    docs = t.documents.select("doc_id", "source", "text")
    pages = ch.clean_pages(docs if wanted is None else docs.join(wanted, "doc_id", "left_semi"))
    c = ch.chunk_text(pages, extra=["source"])
    return c.select("chunk_id", "doc_id", F.lit(1).alias("page"), "section", F.lit("proposal").alias("source_type"),
                    F.col("source").alias("file_name"), F.lit("").alias("sheet_name"),
                    F.lit("").alias("report_period"), "text")


def _document_vectors(t: Tables) -> DataFrame:
    return rt.as_vectors(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")).drop("embedding")


def vector_corpus(t: Tables) -> rt.Corpus:
    """Proposal chunks under their document's vector (documents without a
    vector are not indexed; ``corpus_coverage`` counts them)."""
    emb = _document_vectors(t)

    def chunks(units):
        # only documents with a vector are cut
        wanted = emb.select("doc_id") if units is None else units.select(F.col("unit").cast("long").alias("doc_id"))
        return proposal_chunks(t, wanted).withColumn("unit", F.col("doc_id").cast("string"))

    return rt.Corpus(emb.select(F.col("doc_id").cast("string").alias("unit"), "vec", "vec_norm"), chunks)


def question_batch(t: Tables) -> DataFrame:
    """The question batch: benchmark items; a question's vector is the stored
    vector with the same id (embedding inference is out of scope)."""
    emb = rt.as_vectors(t.embeddings.select(F.col("vec_id").alias("question_id"), "embedding")).drop("embedding")
    return t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question")).join(
        emb, "question_id")


def hits_of(spark, sf_dir, k=rt.DEFAULT_K):
    t = _t(spark, sf_dir)
    return rt.search(vector_corpus(t), question_batch(t), k)


@query("normalize_text")
def q_normalize_text(spark, sf_dir):
    return _t(spark, sf_dir).documents.select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


@query("detect_section")
def q_detect_section(spark, sf_dir):
    d = _t(spark, sf_dir).documents
    return d.select("doc_id", tx.detect_section(tx.normalize_text(F.col("text"))).alias("section"))


@query("low_quality_pages")
def q_low_quality_pages(spark, sf_dir):
    d = _t(spark, sf_dir).documents.select("doc_id", tx.normalize_text(F.col("text")).alias("clean"))
    return d.select("doc_id", F.length("clean").alias("n_chars"), tx.dot_runs(F.col("clean")).alias("dot_runs"),
                    tx.low_quality_page(F.col("clean")).alias("low_quality"))


@query("clean_pages")
def q_clean_pages(spark, sf_dir):
    return ch.clean_pages(_t(spark, sf_dir).documents.select("doc_id", "text")).select(
        "doc_id", F.col("clean").alias("text"))


@query("chunk_text")
def q_chunk_text(spark, sf_dir):
    pages = ch.clean_pages(_t(spark, sf_dir).documents.select("doc_id", "text"))
    return ch.chunk_text(pages)


@query("low_quality_chunks")
def q_low_quality_chunks(spark, sf_dir):
    pages = ch.clean_pages(_t(spark, sf_dir).documents.select("doc_id", "text"))
    spans = pages.select("doc_id", F.explode(ch.chunk_pieces(F.col("clean"))).alias("sp"))
    piece = F.trim("sp.piece")
    return spans.select("doc_id", F.col("sp.s").alias("start"), F.col("sp.e").alias("end"),
                        tx.low_quality_chunk(piece).alias("low_quality"))


@query("markdown_sections")
def q_markdown_sections(spark, sf_dir):
    return ch.markdown_sections(_t(spark, sf_dir).documents.select("doc_id", "text"))


@query("sentence_split")
def q_sentence_split(spark, sf_dir):
    pages = ch.clean_pages(_t(spark, sf_dir).documents.select("doc_id", "text"))
    return pages.select("doc_id", F.posexplode(tx.split_sentences(F.col("clean"))).alias("spos", "sentence"))


@query("useful_sentences")
def q_useful_sentences(spark, sf_dir):
    s = q_sentence_split(spark, sf_dir).withColumn("sentence", tx.strip_ws(F.col("sentence")))
    return s.select("doc_id", "spos", tx.useful_sentence(F.col("sentence")).alias("useful"))


def _user_turns(t: Tables) -> DataFrame:
    return t.conversations.where(F.col("role") == "user").select("conv_id", "turn", "text")


@query("audit_query_flag")
def q_audit_query_flag(spark, sf_dir):
    return _user_turns(_t(spark, sf_dir)).select("conv_id", "turn", tx.audit_query(F.col("text")).alias("audit"))


@query("query_terms")
def q_query_terms(spark, sf_dir):
    u = _user_turns(_t(spark, sf_dir))
    terms = tx.query_terms(F.col("text"))
    kw = tx.keyword_terms(F.col("text"))
    return u.select("conv_id", "turn", F.size(terms).alias("n_terms"),
                    F.array_join(F.array_sort(terms), " ").alias("terms"),
                    F.array_join(F.array_sort(kw), " ").alias("keywords"))


@query("keyword_overlap")
def q_keyword_overlap(spark, sf_dir):
    """Terms of each user turn found in the reply that follows it."""
    t = _t(spark, sf_dir)
    u = _user_turns(t).select("conv_id", "turn", tx.query_terms(F.col("text")).alias("terms"))
    r = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return u.join(r, ["conv_id", "turn"]).select("conv_id", "turn",
                                                 tx.keyword_overlap(F.col("terms"), F.col("reply")).alias("overlap"))


@query("knn_cosine")
def q_knn_cosine(spark, sf_dir):
    t = _t(spark, sf_dir)
    qf = rt.question_frame(question_batch(t))
    c = rt.candidates(vector_corpus(t), qf)
    return c.where(F.col("fetch_rank") <= F.col("k")).select("question_id", "fetch_rank", "chunk_id", "similarity")


@query("knn_overfetch")
def q_knn_overfetch(spark, sf_dir):
    t = _t(spark, sf_dir)
    qf = rt.question_frame(question_batch(t))
    c = rt.candidates(vector_corpus(t), qf)
    return c.select("question_id", "fetch_rank", "chunk_id", "similarity", "fetch_k")


@query("hybrid_rerank")
def q_hybrid_rerank(spark, sf_dir):
    return hits_of(spark, sf_dir).select("question_id", "rank", "chunk_id", "similarity", "score")


@query("ask_topk")
def q_ask_topk(spark, sf_dir):
    h = hits_of(spark, sf_dir)
    return h.where(F.col("rank") <= F.col("k")).select("question_id", "rank", "chunk_id", "score", "audit", "eff_k")


@query("context_blocks")
def q_context_blocks(spark, sf_dir):
    return rt.context_blocks(hits_of(spark, sf_dir))


@query("extractive_answer")
def q_extractive_answer(spark, sf_dir):
    t = _t(spark, sf_dir)
    hits = rt.search(vector_corpus(t), question_batch(t))
    return rt.extractive_answer(question_batch(t), hits)


# ---------------------------------------------------------------- model lab
from ..operators import lab, shap  # noqa: E402


# Cross-validation is shared by the lab queries of one application: the
# out-of-fold predictions of a model are checkpointed once per input.
_CV: dict = {}


def _lab_table(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CV:
        _CV[key] = lab.lab_table(fm_of(_t(spark, sf_dir)))
    return _CV[key]


def _cv(spark, sf_dir, names=None):
    """(table, out-of-fold predictions, metrics, failed models) of the named models (all by default)."""
    from functools import reduce
    from ..session import cut_lineage
    table, parts, errors = _lab_table(spark, sf_dir), [], {}
    for order, model in enumerate(lab.classifiers()):
        if names is not None and model[0] not in names:
            continue
        key = (spark.sparkContext.applicationId, sf_dir, model[0])
        if key not in _CV:
            failed = {}
            found = lab.cv_predictions(table, [model], errors=failed).withColumn("model_order", F.lit(order))
            _CV[key] = cut_lineage(found), {n: (order, said) for n, (_, said) in failed.items()}
        parts.append(_CV[key][0])
        errors |= _CV[key][1]
    found = reduce(DataFrame.unionByName, parts)
    return table, found, lab.classification_metrics(found), errors


@query("impute_features")
def q_impute_features(spark, sf_dir):
    return lab.impute_features(fm_of(_t(spark, sf_dir))).drop("stress")


@query("degenerate_label")
def q_degenerate_label(spark, sf_dir):
    fm = lab.impute_features(plf_of(_t(spark, sf_dir)), ["cogs_ratio"])
    return fm.select("entity", "period", "cogs_ratio", lab.degenerate_label(fm).alias("label"))


@query("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    """M6 on the labels table: quality vs a length score (>= 500 chars)."""
    t = _t(spark, sf_dir)
    d = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    d = d.select("lang", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("proba"),
                 (F.col("n_chars") >= 500).cast("int").alias("predicted"))
    return lab.classification_metrics(d, group_cols=("lang",))


@query("regression_metrics")
def q_regression_metrics(spark, sf_dir):
    return lab.lag1_regression_metrics(pred.daily_features(domain.daily_sales(_t(spark, sf_dir))))


def _one_model(name):
    def q(spark, sf_dir):
        _, _, m, errors = _cv(spark, sf_dir, [name])
        return lab.comparison(m, errors)
    return q


for _key, _name in [("lab_logistic", "Logistic Regression"), ("lab_rf", "Random Forest"),
                    ("lab_gbt", "Gradient Boosting"), ("lab_gbt_sub", "XGBoost")]:
    QUERIES[_key] = _one_model(_name)


@query("lab_cv_predictions")
def q_lab_cv_predictions(spark, sf_dir):
    return _cv(spark, sf_dir)[1]


@query("best_model")
def q_best_model(spark, sf_dir):
    m = _cv(spark, sf_dir)[2]
    return spark.createDataFrame([(lab.best_model(m),)], "best_model string")


def _refit(spark, sf_dir, name=None):
    """(model, scored table) of the named model, the best one by default."""
    table = _lab_table(spark, sf_dir)
    name = name or lab.best_model(_cv(spark, sf_dir)[2])
    key = (spark.sparkContext.applicationId, sf_dir, name, "refit")
    if key not in _CV:
        _CV[key] = lab.refit(table, name)
    return _CV[key]


@query("lab_predictions")
def q_lab_predictions(spark, sf_dir):
    _, scored = _refit(spark, sf_dir)
    return lab.predictions(scored)


@query("lab_importance")
def q_lab_importance(spark, sf_dir):
    model, _ = _refit(spark, sf_dir)
    return lab.importance(model, spark=spark)


@query("lab_shap")
def q_lab_shap(spark, sf_dir):
    """What each feature adds to the forest's stress probability."""
    model, scored = _refit(spark, sf_dir, "Random Forest")
    return shap.shap_values(model, scored, lab.FEATURE_COLS)


def _daily_regression(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "daily")
    if key not in _CV:
        errors = {}
        _CV[key] = lab.daily_regression(pred.daily_features(domain.daily_sales(_t(spark, sf_dir))), errors=errors)[1], errors
    return _CV[key]


@query("lab_daily_regression")
def q_lab_daily_regression(spark, sf_dir):
    return _daily_regression(spark, sf_dir)[0]


@query("lab_comparison")
def q_lab_comparison(spark, sf_dir):
    _, _, m, errors = _cv(spark, sf_dir)
    daily, failed = _daily_regression(spark, sf_dir)
    return lab.full_comparison(m, daily, errors, failed)


# ---------------------------------------------------------------- grid (T1) and audit chunks
from ..operators import grid as gr  # noqa: E402
from ..sources import grid as cells_src  # noqa: E402

PL_LABEL_TEXTS = [label for label, _ in cells_src.PL_LABELS]


def _cells(spark, sf_dir):
    return cells_src.cells(_t(spark, sf_dir))


@query("label_lookup")
def q_label_lookup(spark, sf_dir):
    return gr.label_lookup(_cells(spark, sf_dir), PL_LABEL_TEXTS, 1, sheet="PL")


@query("label_lookup_like")
def q_label_lookup_like(spark, sf_dir):
    labels = ["Sales Value", "Cost of Goods Sold", "Gross Profit", "Net Profit", "Staff Salary", "Total"]
    return gr.label_lookup_like(_cells(spark, sf_dir), labels, [1, 2], sheet="PL")


@query("month_columns")
def q_month_columns(spark, sf_dir):
    c = _cells(spark, sf_dir).where(F.col("sheet") == "PL")
    m3 = F.substring(F.regexp_extract("file", r"- (\w+) \d{4}\.xlsx$", 1), 1, 3)
    return gr.month_columns(c.withColumn("m3", m3), F.col("m3"))


@query("grid_header")
def q_grid_header(spark, sf_dir):
    return gr.grid_header(_cells(spark, sf_dir))


@query("row_to_line")
def q_row_to_line(spark, sf_dir):
    return gr.row_lines(_cells(spark, sf_dir))


@query("section_map")
def q_section_map(spark, sf_dir):
    s = gr.sheets(_cells(spark, sf_dir))
    return s.select("file", "sheet", gr.section_of(F.col("sheet")).alias("section"))


@query("file_inventory")
def q_file_inventory(spark, sf_dir):
    return gr.file_inventory(_cells(spark, sf_dir))


@query("audit_inventory")
def q_audit_inventory(spark, sf_dir):
    return gr.audit_inventory(_cells(spark, sf_dir))


@query("detect_period")
def q_detect_period(spark, sf_dir):
    inv = gr.audit_inventory(_cells(spark, sf_dir))
    return inv.select("file", "period")


@query("cell_probe")
def q_cell_probe(spark, sf_dir):
    probes = [("sales_value", "PL", 3, 1), ("cogs", "PL", 5, 1), ("profit", "PL", 11, 1),
              ("first_creditor_closing", "Creditors Analysis", 3, 4)]
    return gr.cell_probe(_cells(spark, sf_dir), probes)


@query("grid_markdown")
def q_grid_markdown(spark, sf_dir):
    return gr.grid_markdown(_cells(spark, sf_dir))


@query("kpi_summary")
def q_kpi_summary(spark, sf_dir):
    return gr.kpi_summary(_cells(spark, sf_dir))


@query("audit_chunks")
def q_audit_chunks(spark, sf_dir):
    return gr.audit_chunks(cells_src.cells(_t(spark, sf_dir), stored=True))


@query("ingest_manifest")
def q_ingest_manifest(spark, sf_dir):
    return gr.ingest_manifest(gr.audit_chunks(cells_src.cells(_t(spark, sf_dir), stored=True)))


@query("corpus_union")
def q_corpus_union(spark, sf_dir):
    """Proposal chunks, summary sections and audit chunks in one corpus."""
    t = _t(spark, sf_dir)
    cols = ["chunk_id", "page", "section", "source_type", "file_name", "sheet_name", "report_period", "text"]
    prop = proposal_chunks(t).select(*cols)
    summ = ch.markdown_sections(t.documents.select("doc_id", "text")).select(
        "chunk_id", F.lit(0).alias("page"), "section", F.lit("proposal").alias("source_type"),
        F.lit("").alias("file_name"), F.lit("").alias("sheet_name"), F.lit("").alias("report_period"), "text")
    audit = gr.audit_chunks(cells_src.cells(t, stored=True)).select(*cols)
    return prop.unionByName(summ).unionByName(audit).select("chunk_id", "source_type", "section",
                                                             F.length("text").alias("n_chars"))


@query("corpus_coverage")
def q_corpus_coverage(spark, sf_dir):
    """Documents per source that the search can find, and those without a vector."""
    t = _t(spark, sf_dir)
    known = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("known")).distinct()
    return t.documents.select("doc_id", "source").join(known, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count("known").alias("n_indexed"),
        (F.count("*") - F.count("known")).alias("n_without_vector"))


# ---------------------------------------------------------------- sinks
from ..functions.numbering import dense_numbers  # noqa: E402
from ..sources import sinks  # noqa: E402


def _hash_mod(col, part: int, n) -> Column:
    """A number below ``n`` from the ``part``-th eight hex digits of the MD5 of ``col``."""
    digits = F.substring(F.md5(F.col(col).cast("binary")), 1 + 8 * part, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), n)


def audit_index(t: Tables) -> DataFrame:
    """Audit chunks with a vector each, stored once in the shared folder.

    Embedding inference is out of scope, so a chunk takes a stored vector: of the
    vectors that exist and are not empty, in the order of their ids, the one at the
    place that the first part of its id's hash gives modulo their number, turned
    by the second part modulo its length.  So gaps and nulls lose no chunk."""
    stored = dense_numbers(t.embeddings.where(F.size("embedding") > 0).select("vec_id", "embedding"), "vec_id", "place")
    n = stored.count()
    chunks = gr.audit_chunks(cells_src.cells(t, stored=True)).withColumn("place", _hash_mod("chunk_id", 0, F.lit(n)))
    both = chunks.join(stored.select("place", "embedding"), "place").drop("place")
    size, turn = F.size("embedding"), _hash_mod("chunk_id", 1, F.size("embedding").cast("long")).cast("int")
    turned = F.concat(F.slice("embedding", turn + 1, size - turn), F.slice("embedding", F.lit(1), turn))
    rows = rt.as_vectors(both.withColumn("embedding", turned)).drop("embedding").withColumn("doc_id", F.lit(None).cast("long"))
    return sinks.parquet_roundtrip(rows, "audit_index")


def whole_corpus(t: Tables, audit: DataFrame) -> rt.Corpus:
    """T11 in full: proposal chunks and summary sections under their document's
    vector, audit chunks under their own, of which each is the first and only one."""
    docs = vector_corpus(t)
    audits = audit.withColumn("unit", F.col("chunk_id"))

    def document_chunks(units):
        ids = _document_vectors(t).select("doc_id") if units is None else units.select(F.expr("try_cast(unit as bigint)").alias("doc_id"))
        wanted = t.documents.select("doc_id", "source", "text").join(ids, "doc_id", "left_semi")
        summaries = ch.markdown_sections(wanted.select("doc_id", "text")).select(
            "chunk_id", "doc_id", F.lit(0).alias("page"), "section", F.lit("proposal").alias("source_type"), F.lit("").alias("file_name"),
            F.lit("").alias("sheet_name"), F.lit("").alias("report_period"), "text", F.col("doc_id").cast("string").alias("unit"))
        proposals = docs.chunks(None if units is None else units.where(F.expr("try_cast(unit as bigint) is not null")))
        return proposals.unionByName(summaries)

    def chunks(units):
        audit_rows = audits if units is None else audits.join(units, "unit", "left_semi")
        return document_chunks(units).unionByName(audit_rows.select("unit", *rt.HIT_COLS))

    own = audits.where(F.col("unit").isNotNull()).select("unit", "vec", "vec_norm")
    firsts = rt.with_first_chunk(docs.vectors, document_chunks(None)).unionByName(own.withColumn("first_chunk", F.col("unit")))
    return rt.Corpus(docs.vectors.unionByName(audits.select("unit", "vec", "vec_norm")), chunks, firsts)


def audit_questions(audit: DataFrame) -> DataFrame:
    """One question for each sheet and period that the reports have, with the vector of its first chunk."""
    each = audit.groupBy("sheet_name", "report_period").agg(F.min_by(F.struct("vec", "vec_norm"), "chunk_id").alias("v"))
    text = F.concat(F.lit("What does the audit show in "), F.col("sheet_name"), F.lit(" for "), F.col("report_period"), F.lit("?"))
    return each.select(F.xxhash64(text).alias("question_id"), text.alias("question"), "v.vec", "v.vec_norm")


def corpus_hits(t: Tables) -> tuple[DataFrame, DataFrame]:
    """All questions (benchmark items and audit questions) and their hits in the whole corpus."""
    audit = audit_index(t)
    # stored: every step of the search would read all audit vectors for them again
    questions = question_batch(t).unionByName(sinks.parquet_roundtrip(audit_questions(audit), "audit_questions"))
    return questions, rt.search(whole_corpus(t, audit), questions)


@query("ask_corpus")
def q_ask_corpus(spark, sf_dir):
    _, hits = corpus_hits(_t(spark, sf_dir))
    return hits.select("question_id", "rank", "chunk_id", "source_type", "page", "section", "audit", "similarity", "score")


@query("answer_corpus")
def q_answer_corpus(spark, sf_dir):
    """Answers over the whole corpus with their sources."""
    questions, hits = corpus_hits(_t(spark, sf_dir))
    answers = rt.extractive_answer(questions, hits)
    return answers.join(rt.answer_sources(hits), "question_id", "left").withColumn("sources", F.to_json("sources"))


@query("sink_roundtrip")
def q_sink_roundtrip(spark, sf_dir):
    """The feature matrix written as parquet partitioned by period and read back."""
    return sinks.parquet_roundtrip(fm_of(_t(spark, sf_dir)), "feature_matrix", ["period"])


@query("daily_csv_roundtrip")
def q_daily_csv_roundtrip(spark, sf_dir):
    """S12 + S6: daily sales exported to CSV and read back with its schema."""
    return sinks.csv_roundtrip(domain.daily_sales(_t(spark, sf_dir)), "daily_sales")


@query("monthly_pl_csv_roundtrip")
def q_monthly_pl_csv_roundtrip(spark, sf_dir):
    """The monthly P&L exported to CSV and read back with its schema."""
    return sinks.csv_roundtrip(domain.monthly_pl(_t(spark, sf_dir)), "monthly_pl")


@query("manifest_roundtrip")
def q_manifest_roundtrip(spark, sf_dir):
    """S12 + S13: the ingest manifest written and read back."""
    return sinks.parquet_roundtrip(gr.ingest_manifest(gr.audit_chunks(cells_src.cells(_t(spark, sf_dir), stored=True))), "manifest")


@query("model_comparison_roundtrip")
def q_model_comparison_roundtrip(spark, sf_dir):
    """S12 + M14: the model comparison exported to CSV and read back with its schema."""
    return sinks.csv_roundtrip(q_lab_comparison(spark, sf_dir), "model_comparison")


@query("index_upsert")
def q_index_upsert(spark, sf_dir):
    """The chunk index, then a re-ingest of the labelled documents
    (version 1, carrying their quality label) upserted on top."""
    t = _t(spark, sf_dir)
    base = proposal_chunks(t).select("chunk_id", "doc_id", F.lit(0).cast("long").alias("version"),
                                     F.lit(None).cast("int").alias("quality"))
    relabel = (proposal_chunks(t).join(t.labels.select("doc_id", "quality"), "doc_id")
               .select("chunk_id", "doc_id", F.lit(1).cast("long").alias("version"), "quality"))
    return sinks.upsert(base, relabel)


# ---------------------------------------------------------------- D3 anomalies
from ..operators import anomaly  # noqa: E402


@query("anomaly_iforest")
def q_anomaly_iforest(spark, sf_dir):
    return anomaly.anomaly_iforest(domain.daily_sales(_t(spark, sf_dir)))


# ---------------------------------------------------------------- remaining inventory items
from ..functions import scalar as sc  # noqa: E402


@query("top_creditor")
def q_top_creditor(spark, sf_dir):
    """The creditor with the largest closing balance per (entity, period)."""
    from pyspark.sql import Window
    p = domain.party_balances(_t(spark, sf_dir)).where(F.col("type") == "creditor")
    w = Window.partitionBy("entity", "period").orderBy(F.col("closing").desc(), F.col("party"))
    return (p.withColumn("rk", F.row_number().over(w)).where(F.col("rk") == 1)
             .select("entity", "period", "party", "closing"))


@query("pl_from_grid")
def q_pl_from_grid(spark, sf_dir):
    """S3: the P&L read back from the report grids (equals monthly_pl)."""
    return gr.pl_from_cells(_cells(spark, sf_dir), cells_src.PL_LABELS)


@query("lenient_number")
def q_lenient_number(spark, sf_dir):
    """X1 over every text cell of the report grids (labels, percents, names)."""
    c = _cells(spark, sf_dir).where(F.col("str_value").isNotNull())
    return c.select("file", "sheet", "row_idx", "col_idx", sc.lenient_number(F.col("str_value")).alias("value"))


@query("clean_cell")
def q_clean_cell(spark, sf_dir):
    """X2 over the raw document source and language fields."""
    d = _t(spark, sf_dir).documents
    return d.select("doc_id", sc.clean_cell(F.col("source")).alias("source"), sc.clean_cell(F.col("lang")).alias("lang"))


@query("format_numbers")
def q_format_numbers(spark, sf_dir):
    """X3 long and short forms of P&L amounts and ratios."""
    pl = domain.monthly_pl(_t(spark, sf_dir))
    return pl.select("entity", "period",
                     sc.format_long(F.col("sales_value")).alias("sales_long"),
                     sc.format_short(F.col("sales_value")).alias("sales_short"),
                     sc.format_long(F.col("gross_margin")).alias("margin_long"),
                     sc.format_short(F.col("profit")).alias("profit_short"))


from ..operators import line_packing as lp  # noqa: E402


@query("chunk_lines")
def q_chunk_lines(spark, sf_dir):
    """X8 on every sheet's whole table (900-char line packing)."""
    return lp.pack_lines(gr.sheet_lines(_cells(spark, sf_dir), blocks=True), gr.KEY)


@query("monthly_pl_legacy")
def q_monthly_pl_legacy(spark, sf_dir):
    """The P&L read from annual workbooks (months as columns); equals monthly_pl."""
    cells = cells_src.legacy_pl_cells(domain.monthly_pl(_t(spark, sf_dir)))
    return gr.pl_from_cells_legacy(cells, cells_src.PL_LABELS, {2 * m - 1: m for m in range(1, 13)})


# ---------------------------------------------------------------- sheets read back by position, and source routing
from ..operators import sheet_readers as sr  # noqa: E402
from ..sources import routing, sheets  # noqa: E402

MIN_REPORTS, WANTED_REPORTS = 5, 6


@query("sales_from_grid")
def q_sales_from_grid(spark, sf_dir):
    """Monthly sales read back from the sales sheets, with the two years before."""
    return sr.read_monthly_sales(sheets.sales_cells(_t(spark, sf_dir)))


@query("parties_from_grid")
def q_parties_from_grid(spark, sf_dir):
    """Balances read back from the party sheets (equals party_balances)."""
    return sr.read_parties(_cells(spark, sf_dir))


@query("wastage_from_grid")
def q_wastage_from_grid(spark, sf_dir):
    """Wastage read back from its sheets (equals wastage)."""
    return sr.read_wastage(sheets.wastage_cells(_t(spark, sf_dir)))


@query("categories_from_grid")
def q_categories_from_grid(spark, sf_dir):
    """The category snapshot read back (equals category_sales)."""
    return sr.read_categories(sheets.category_cells(_t(spark, sf_dir)))


@query("daily_from_grid")
def q_daily_from_grid(spark, sf_dir):
    """Daily sales from sheets with hand-written dates (equals daily_sales)."""
    return sr.read_daily_sales(sheets.daily_cells(_t(spark, sf_dir)))


@query("daily_rejected")
def q_daily_rejected(spark, sf_dir):
    """Rows of the daily sheets that are no valid day, counted by outlet and reason."""
    d = sr.rejected_days(sheets.daily_cells(_t(spark, sf_dir)))
    return d.groupBy("entity", "reason").agg(F.count("*").alias("n"))


from ..operators import probes  # noqa: E402


@query("report_probes")
def q_report_probes(spark, sf_dir):
    """Margin, sales, cash-flow, wastage, purchase and salary probes of every monthly report."""
    return probes.report_probes(sheets.report_cells(_t(spark, sf_dir)))


@query("kpi_summary_full")
def q_kpi_summary_full(spark, sf_dir):
    """G7 with the lines of margin, sales and cash-flow sheets."""
    cells = sheets.all_cells(_t(spark, sf_dir))
    return gr.kpi_summary(cells, more_lines=probes.summary_lines(cells))


def wanted_periods(t: Tables, n: int = WANTED_REPORTS) -> DataFrame:
    """The last ``n`` calendar months that the ledger reaches."""
    last = t.lineitem.agg(F.trunc(F.max("l_shipdate"), "month").alias("last"))
    months = F.sequence(F.add_months("last", 1 - n), F.col("last"), F.expr("interval 1 month"))
    return last.select(F.explode(months).alias("d")).select(sc.period_of("d").alias("period"))


def routed_pl(t: Tables, least: int = MIN_REPORTS) -> DataFrame:
    """The wanted periods' P&L; entities with ``least`` or more monthly reports come from these (S3), others from their annual workbook."""
    parts = cells_src.parts_for(t)
    pl = domain.monthly_pl(t, parts)
    monthly = gr.pl_from_cells(cells_src.pl_cells(pl, parts), cells_src.PL_LABELS)
    annual = gr.pl_from_cells_legacy(cells_src.legacy_pl_cells(pl), cells_src.PL_LABELS, {2 * m - 1: m for m in range(1, 13)})
    return routing.by_coverage(routing.Source("monthly", monthly), routing.Source("legacy", annual), "entity", "period", wanted_periods(t), least)


@query("routed_pl")
def q_routed_pl(spark, sf_dir):
    return routed_pl(_t(spark, sf_dir))


@query("routed_pl_complete")
def q_routed_pl_complete(spark, sf_dir):
    """S1 where an entity needs every wanted report, so that more of them take the annual workbook."""
    return routed_pl(_t(spark, sf_dir), WANTED_REPORTS)


@query("routed_daily")
def q_routed_daily(spark, sf_dir):
    """Daily sales of every outlet from its workbook, or from the exported CSV where there is none.

    The workbook belongs to the monthly layout: outlets whose entity has every wanted report have one."""
    t = _t(spark, sf_dir)
    monthly = routed_pl(t, WANTED_REPORTS).where("route = 'monthly'").select("entity").distinct()
    workbook = sr.read_daily_sales(sheets.daily_cells(t, monthly))
    exported = sinks.csv_roundtrip(domain.daily_sales(t), "daily_sales")
    wanted = t.events.select(F.expr("user_id div 3").alias("entity")).distinct()
    return routing.first_present([routing.Source("workbook", workbook), routing.Source("csv", exported)], ["entity"], wanted)


# ---------------------------------------------------------------- J4 at size: inverted lists, with the exact scan beside
from ..operators import vector_index as vi  # noqa: E402

NEIGHBOURS = 10


def _all_vectors(t: Tables) -> DataFrame:
    return rt.as_vectors(t.embeddings.where(F.size("embedding") > 0).select(F.col("vec_id").cast("string").alias("unit"), "embedding")).drop("embedding")


def _asking_vectors(t: Tables) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 100."""
    return _all_vectors(t).where(F.col("unit").cast("long") % 100 == 0).withColumnRenamed("unit", "question_id").withColumn("question_id", F.col("question_id").cast("long"))


def _ranked(found: DataFrame) -> DataFrame:
    """Without the question's own vector, the best by similarity, ties by id."""
    from pyspark.sql import Window
    hits = found.withColumn("vec_id", F.col("unit").cast("long")).where("vec_id <> question_id")
    w = Window.partitionBy("question_id").orderBy(F.col("similarity").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEIGHBOURS).select("question_id", "rank", "vec_id", "similarity")


def _exact_neighbours(t: Tables) -> DataFrame:
    # ties in similarity go by number, so the scan is asked by a key that sorts like the number
    units = _all_vectors(t).withColumn("first_chunk", F.lpad("unit", 20, "0"))
    return _ranked(rt.best_units(units, _asking_vectors(t), NEIGHBOURS + 1))


def _indexed_neighbours(t: Tables) -> DataFrame:
    index = vi.build(_all_vectors(t), sinks.scratch_path(t.spark, "vector_index"))
    asking = _asking_vectors(t)
    probes = vi.calibrate(index, asking, asking.count(), NEIGHBOURS + 1)
    return _ranked(vi.search(index, asking, NEIGHBOURS + 1, probes))


@query("knn_exact")
def q_knn_exact(spark, sf_dir):
    """The nearest vectors of every vector whose id is divisible by 100, against all rows."""
    return _exact_neighbours(_t(spark, sf_dir))


@query("knn_index")
def q_knn_index(spark, sf_dir):
    """J4 at size: the same questions through the inverted-list index."""
    return _indexed_neighbours(_t(spark, sf_dir))


@query("knn_index_recall")
def q_knn_index_recall(spark, sf_dir):
    """How many of a question's exact neighbours the index finds."""
    t = _t(spark, sf_dir)
    found = _indexed_neighbours(t).select("question_id", "vec_id", F.lit(1).alias("hit"))
    return _exact_neighbours(t).join(found, ["question_id", "vec_id"], "left").groupBy("question_id").agg(
        F.count("*").alias("n"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))

"""Labels, id matching and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as S
from checks.frame import rounded
from checks.registry import Registry
from kindred.functions import ids
from kindred.operators import classify, labels as L, linear_models
from kindred.operators.scale_out import running_total, scratch_path
from kindred.operators.store import concatenate

check = Registry()
_VEC = S.with_(S.VEC)


def _docs(spark, sf):
    return I.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")


def _labels(spark, sf):
    return I.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")


@check("j8_pending", "select doc_id as id, lang from documents where doc_id not in (select doc_id from labels)")
def j8_pending(spark, sf):
    return L.pending(_docs(spark, sf), _labels(spark, sf))


@check("j9_subset", """select doc_id as id, lang, row_number() over (order by doc_id desc) as position
from documents join labels using (doc_id)""")
def j9_subset(spark, sf):
    wanted = running_total(_labels(spark, sf).select("id", (-F.col("id")).alias("_turned")), [], ["_turned"])
    return L.subset_in_order(_docs(spark, sf), wanted).select("id", "lang", "position")


@check("j10_match_report", """select coalesce(d.doc_id, l.id) as id, case when l.id is null then 'only_documents'
when d.doc_id is null then 'only_labels' else 'both' end as status
from documents d full join (select doc_id + 1 as id from labels) l on d.doc_id = l.id""")
def j10_match_report(spark, sf):
    shifted = _labels(spark, sf).select((F.col("id") + 1).alias("id"))
    return L.match_report(_docs(spark, sf), shifted, ("documents", "labels"))


@check("j11_align", _VEC + """select 'song_' || id as id, class, quality, round(rp[1], 6) + 0.0 as rp_1
from vec join labels on doc_id = id""")
def j11_align(spark, sf):
    features = I.vec(spark, sf).withColumn("id", F.concat(F.lit("Music/"), F.col("class"), F.lit("/Song_"), F.col("id"), F.lit(".MP3")))
    classes = _labels(spark, sf).select(F.concat(F.lit("other/song_"), F.col("id"), F.lit(".wav")).alias("id"), "quality")
    out = L.align(features, classes, strip=True, lower=True)
    return rounded(out.select("id", "class", "quality", F.element_at("rp", 1).alias("rp_1")))


@check("j12_predictions", """select doc_id::varchar as id, case when n_chars > 1000 then 1 else 0 end as predicted_quality,
case when lang = 'en' then 0 else 1 end as predicted_toxic, quality as true_quality, toxic as true_toxic
from documents join labels using (doc_id)""")
def j12_predictions(spark, sf):
    predicted = I.table(spark, sf, "documents").select(
        F.concat(F.lit("out/"), F.col("doc_id"), F.lit(".txt")).alias("id"),
        (F.col("n_chars") > 1000).cast("int").alias("quality"), (F.col("lang") != "en").cast("int").alias("toxic"))
    return L.align_predictions(predicted, _labels(spark, sf))


@check("c1_name_classes", r"select page_id, split_part(regexp_replace(url, '.*://', ''), '/', 1) as class from pages")
def c1_name_classes(spark, sf):
    pages = I.table(spark, sf, "pages").select("page_id", F.regexp_replace("url", ".*://", "").alias("id"))
    return L.classes_from_ids(pages).select("page_id", "class")


@check("c2_encoding", "select event_id, event_type as class, dense_rank() over (order by event_type) - 1 as code, event_type as decoded from events")
def c2_encoding(spark, sf):
    events = I.table(spark, sf, "events").select("event_id", F.col("event_type").alias("class"))
    codes = L.encoder(events)
    back = L.decode(L.encode(events, codes).withColumnRenamed("class", "original"), codes)
    return back.select("event_id", F.col("original").alias("class"), "code", F.col("class").alias("decoded"))


@check("c3_lookup", "select doc_id as id, coalesce(quality, -1) as quality, coalesce(toxic, -1) as toxic from documents left join labels using (doc_id)")
def c3_lookup(spark, sf):
    return L.lookup_classes(_docs(spark, sf), _labels(spark, sf)).select("id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")])


@check("c4_restrict", _VEC + "select id, class from vec where class in (1, 3, 5)")
def c4_restrict(spark, sf):
    return L.restrict_to_classes(I.vec(spark, sf), [1, 3, 5]).select("id", "class")


@check("c5_min_members", _VEC + "select id, class from vec qualify count(*) over (partition by class) >= 50")
def c5_min_members(spark, sf):
    return L.at_least(I.vec(spark, sf), 50).select("id", "class")


@check("c6_counts", _VEC + "select class, count(*) as members from vec group by class")
def c6_counts(spark, sf):
    return L.class_counts(I.vec(spark, sf))


@check("c6_ids_of_class", _VEC + "select id from vec where class = 7")
def c6_ids_of_class(spark, sf):
    return L.ids_of_class(I.vec(spark, sf), 7)


@check("c7_baseline", _VEC + "select round(max(n) / sum(n), 6) + 0.0 as baseline from (select count(*) as n from vec group by class)")
def c7_baseline(spark, sf):
    return rounded(L.majority_baseline(I.vec(spark, sf)))


@check("c8_label_lists", """select doc_id as id, case when quality = 1 and toxic = 1 then 'quality,toxic' when quality = 1 then 'quality'
when toxic = 1 then 'toxic' else '' end as classes from labels""")
def c8_label_lists(spark, sf):
    return _labels(spark, sf).select("id", L.positive_labels(["quality", "toxic"]).alias("classes"))


@check("c9_strip", r"""select page_id, regexp_replace(url, '^.*/', '') as name,
regexp_replace(regexp_replace(url, '^.*/', ''), '([^.])\.[^.]*$', '\1') as stem from pages""")
def c9_strip(spark, sf):
    name = ids.strip_path(F.col("url"))
    return I.table(spark, sf, "pages").select("page_id", name.alias("name"), ids.strip_extension(name).alias("stem"))


@check("c10_concatenate", _VEC + "select id, 52::bigint as n, round(rp[40], 6) + 0.0 as x40, round(rh[1], 6) + 0.0 as x41 from vec")
def c10_concatenate(spark, sf):
    vec = I.vec(spark, sf)
    both = vec.select("id", "rp").join(vec.select("id", "rh"), "id").select("id", concatenate("rp+rh"))
    return rounded(both.select("id", F.size("rp_rh").cast("long").alias("n"), F.element_at("rp_rh", 40).alias("x40"),
                               F.element_at("rp_rh", 41).alias("x41")))


@check("c11_standardise", _VEC + """select id, pos - 1 as pos, round((x - avg(x) over w) / nullif(stddev_pop(x) over w, 0), 6) + 0.0 as value
from (select id, unnest(rp) as x, unnest(range(1, 41)) as pos from vec) window w as (partition by pos)""")
def c11_standardise(spark, sf):
    out = classify.standardise(I.vec(spark, sf), "rp").select("id", F.posexplode("rp").alias("pos", "value"))
    return rounded(out.withColumn("pos", F.col("pos").cast("long")))


@check("c12_svm", _VEC + """select count(*) as scored, 0::bigint as unknown, true as at_least_majority from vec""")
def c12_svm(spark, sf):
    """All rows get a known class, and training gives at least what the most frequent class would."""
    vec = I.vec(spark, sf)
    model = classify.train(vec, "rp", "class", iterations=10)
    predicted = classify.predict(model, vec, "rp", "class").join(
        F.broadcast(vec.select(F.col("class").alias("known")).distinct()), F.col("predicted") == F.col("known"), "left")
    baseline = L.majority_baseline(vec).select("baseline").scalar()
    return predicted.agg(
        F.count("*").alias("scored"), F.count_if(F.col("known").isNull()).alias("unknown"),
        (F.avg((F.col("predicted") == F.col("class")).cast("double")) >= baseline - 1e-9).alias("at_least_majority"))


@check("c13_cross_validation", _VEC + """select (id % 3)::int as fold, count(*) as held_out, true as is_share from vec group by 1""")
def c13_cross_validation(spark, sf):
    vec, fold = I.vec(spark, sf), (F.col("id") % 3).cast("int")
    scores = classify.cross_validate(vec, "rp", "class", folds=3, iterations=5, fold_of=fold)
    sizes = vec.groupBy(fold.alias("fold")).agg(F.count("*").alias("held_out"))
    return sizes.join(scores, "fold").select("fold", "held_out", F.col("accuracy").between(0, 1).alias("is_share"))


@check("c13_label_cross_validation", "select unnest(['quality', 'toxic']) as label, true as is_share")
def c13_label_cross_validation(spark, sf):
    rows = I.vec(spark, sf).join(_labels(spark, sf), "id")
    scores = classify.cross_validate_labels(rows, "rp", ["quality", "toxic"], folds=2, iterations=5)
    return scores.select("label", F.col("accuracy").between(0, 1).alias("is_share"))


@check("c13_stratified_folds", _VEC + """select class, fold, count(*) as n from (
select class, ((row_number() over (partition by class order by id) - 1) % 4)::int as fold from vec) group by all""")
def c13_stratified_folds(spark, sf):
    dealt = linear_models.stratified_folds(I.vec(spark, sf).select("id", "class"), "class", 4, by=["id"])
    return dealt.groupBy("class", "fold").agg(F.count("*").alias("n"))


def _separable(spark, sf):
    """Vectors that one component tells apart by class, whatever the other forty say."""
    own = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.when(c == F.col("class"), 2.0).otherwise(0.0))
    return I.vec(spark, sf).select("id", "class", F.concat(own, "rp").alias("x"))


@check("c12_separable", _VEC + "select count(*) as scored, count(*) as right from vec")
def c12_separable(spark, sf):
    """Any linear model that is trained right knows all rows of a separable table."""
    rows = _separable(spark, sf)
    models = linear_models.train_together(rows, "x", "class", iterations=40)
    found = linear_models.predict_together(models, rows, "x")
    return found.agg(F.count("*").alias("scored"), F.count_if(F.col("predicted") == F.col("class")).alias("right"))


@check("c13_separable", "select unnest(range(3))::int as fold, 1.0::double as accuracy")
def c13_separable(spark, sf):
    return classify.cross_validate(_separable(spark, sf), "x", "class", folds=3, iterations=40)


@check("c14_saved_model", _VEC + "select count(*) as scored, 0::bigint as changed from vec")
def c14_saved_model(spark, sf):
    """Predictions before and after saving, row by row."""
    vec, path = I.vec(spark, sf), scratch_path(spark, "model")
    model = classify.train(vec, "rp", "class", iterations=10)
    classify.save_model(model, path)
    before = classify.predict(model, vec, "rp", "class").select("id", F.col("predicted").alias("before"))
    after = classify.predict(classify.load_model(path), vec, "rp", "class").select("id", "predicted")
    return before.join(after, "id").agg(
        F.count("*").alias("scored"), F.count_if(F.col("before") != F.col("predicted")).alias("changed"))

import json

from pyspark.sql import functions as F

from evalspark.plans import flows
from evalspark.session import materialize


def test_end_to_end(spark):
    bodies = spark.createDataFrame(
        [
            ("b1", json.dumps([{"prompt": "What is the capital of France?", "reference_answer": "Paris is the capital of France."},
                               {"prompt": "", "reference_answer": "x"}])),
            ("b2", json.dumps({"prompt": "Name a primary colour.", "reference_answer": "Red is a primary colour.", "context": "Colours: red, blue."})),
        ],
        "batch_id string, body string",
    )
    models = F.array(F.lit("Echo"), F.lit("Broken"))
    got = flows.intake(bodies, models)
    assert got["errors"].count() == 1
    evals = materialize(got["evaluations"])

    def factory(model):
        if model == "Broken":
            return lambda p: (_ for _ in ()).throw(RuntimeError("down"))
        return lambda p: "Paris is the capital of France." if "France" in p else "Blue is a primary colour."

    r = flows.respond(got["work"].join(evals.select("evaluation_id"), "evaluation_id"), factory)
    results = materialize(r["results"])
    responses = results.where("status = 'RECEIVED'").select("evaluation_id", "model", "response")
    events = materialize(flows.response_events(results))
    c = flows.complete(evals, events)
    ready_ids = {x.evaluation_id for x in c["ready"].collect()}
    assert len(ready_ids) == 2  # Broken failed, Echo received: complete with failures counted
    s = flows.score(c["ready"], c["with_map"], responses)
    docs = {d.evaluation_id: d.model_comparisons for d in s["documents"].collect()}
    assert len(docs) == 2
    for mc in docs.values():
        assert mc["Broken"].status == "SKIPPED_NOT_RECEIVED"
        assert mc["Echo"].status == "COMPLETED"
    best = max(mc["Echo"].metrics["ROUGE-1_F1"] for mc in docs.values())
    assert best == 1.0
    rep = spark.createDataFrame(
        [(1, "p", {"A": {"BLEU": "0.5", "METEOR": "0.7"}, "B": {"BLEU": "0.6", "METEOR": "0.9"}})],
        "SNO long, prompt string, models map<string,map<string,string>>",
    )
    d = flows.dashboard(rep, metrics=["BLEU", "METEOR"])
    assert [w.model for w in d["winner"].collect()] == ["B"]
    assert d["matrix"].count() == 2

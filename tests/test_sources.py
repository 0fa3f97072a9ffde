import json

from trackweave.operators import evaluate
from trackweave.sources import sidecars


def put(path, doc):
    path.write_text(json.dumps(doc, indent=1))
    return str(path)


def test_tracks_truth_identities_and_score(spark, tmp_path):
    """Ten tracks labelled as the truth says score 1; a swap, a missing player and a collapse span change it as they must."""
    frames = {str(f): [{"tid": t, "box": [10.0 * t, 0, 10.0 * t + 8, 20]} for t in range(10)] for f in range(50)}
    tracks = sidecars.tracks(spark, put(tmp_path / "c.json", {"video": "v", "fps": 59.94, "every": 1, "frames": frames}))
    assert tracks.count() == 500
    club = lambda t: "home" if t < 5 else "away"
    (tmp_path / "truth").mkdir()
    truth = sidecars.truth(spark, put(tmp_path / "truth" / "c.json", {"fps": 59.94, "tracks": {str(t): {"segments": [[str(t % 5), 0, 49, club(t)] if t else ["0", 0, 49]]} for t in range(10)}}))
    assert truth.where("club is null").count() == 1

    def scored(change, collapse):
        doc = {"identities": {str(t): {"number": str(t % 5), "club": club(t)} | change.get(t, {}) for t in range(10)}, "overlap": {"collapse": collapse}}
        (tmp_path / "ids").mkdir(exist_ok=True)
        ids, spans = sidecars.identities(spark, put(tmp_path / "ids" / "c.json", doc))
        r = evaluate.score(evaluate.judged(evaluate.drawn(tracks, ids, spans), truth), tracks).first()
        return r.n_right, r.n_wrong, round(r.precision, 4), round(r.coverage, 4)

    assert scored({}, {}) == (500, 0, 1.0, 1.0)
    assert scored({3: {"number": None}}, {}) == (450, 0, 1.0, 0.9)
    assert scored({1: {"club": "away"}, 6: {"club": "home"}}, {}) == (400, 100, 0.8, 0.8)
    assert scored({}, {"4": [[10, 19]]}) == (490, 0, 1.0, 0.98)


def test_roster_settings_ledger_coco_and_append(spark, tmp_path):
    rows = sidecars.roster(spark, put(tmp_path / "r.json", {"_source": "x", "knights": [{"num": 0, "name": "A B"}, {"num": "00", "name": "C D"}]}))
    assert sorted(map(tuple, rows.collect())) == [("knights", "0", "A B"), ("knights", "00", "C D")]
    (tmp_path / "env").write_text("# note\n\nKEY = 'a=b'\nnothing\nQ=\"x\"\n")
    assert sorted(map(tuple, sidecars.settings(spark, str(tmp_path / "env")).collect())) == [("KEY", "a=b"), ("Q", "x")]
    (tmp_path / "l.jsonl").write_text('{"purpose": "audit", "cost_usd": 0.5}\nbroken\n{"purpose": "audit", "cost_usd": null}\n')
    assert sidecars.ledger(spark, str(tmp_path / "l.jsonl"), "purpose string, cost_usd double").count() == 2
    c = sidecars.coco(spark, put(tmp_path / "coco.json", {"images": [{"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}], "annotations": [{"id": 7, "image_id": 1, "category_id": 3, "bbox": [0, 0, 2, 2]}]}))
    assert sorted((r.image_id, r.annotation_id) for r in c.collect() if r.annotation_id) == [(1, 7)] and c.count() == 2
    out = str(tmp_path / "archive")
    one = spark.createDataFrame([("a", 1)], "job string, started long")
    sidecars.append(one, out)
    sidecars.append_missing(spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "job string, started long"), out, ["job", "started"])
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 1), ("b", 2)]


def test_calibration_keeps_usable_frames(spark, tmp_path):
    eye = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    frames = [{"frame": 0, "solved": True, "H_court_to_image": eye}, {"frame": 5, "solved": True, "suspect": True, "H_court_to_image": eye}, {"frame": 9, "solved": False}]
    got = sidecars.calibration(spark, put(tmp_path / "k.json", {"frames": frames})).collect()
    assert [(r.frame, r.h) for r in got] == [(0, [1, 0, 0, 0, 1, 0, 0, 0, 1])]

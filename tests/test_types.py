"""Types of values across files, and the calls that they resolve, against hand-written expectations."""

from __future__ import annotations

import pytest

from orrery.operators import extract, types

FILES = {
    "Source/Core/Clock.js": """
import { Instant } from "./Instant";
export default class Clock {
  tick() { return this; }
  reset() { }
  now() { return new Instant(); }
}
""",
    "Source/Core/Instant.js": """
export class Instant {
  add() { return this; }
  reset() { }
}
""",
    "Source/Core/Factory.js": """
import Clock from "./Clock.js";
import { Instant as Moment } from "./Instant.js";
export function makeClock() { const made = new Clock(); return made; }
export const makeMoment = () => { return new Moment(); };
function hidden() { return makeClock(); }
export { hidden as viaHidden };
""",
    "Source/Scene/Scene.js": """
import Clock from "../Core/Clock.js";
import { makeClock, makeMoment, viaHidden } from "../Core/Factory.js";
import { Base } from "./Base.js";
export class Scene extends Base {
  constructor() { this.clock = makeClock(); this._moment = this.clock.now(); }
  render() {
    const c = this.clock;
    c.reset();
    this._moment.reset();
    this.clock.tick().tick().reset();
  }
  step(reset) {
    let a = viaHidden();
    let b = a;
    b.reset();
    const m = makeMoment().add();
    m.reset();
    reset.reset();
  }
  mixed() {
    let v = new Clock();
    v = makeMoment();
    v.reset();
  }
  own() { this.update(); const s = new Scene(); s.update(); s.reset(); }
  shadow() { const clock = new Scene(); clock.render(); }
}
""",
    "Source/Scene/Base.js": """
export class Base {
  update() { }
  reset() { }
}
""",
    "Source/Old/Old.js": """
import { Scene } from "../Scene/Scene.js";
/** Made by prototypes.
 * @alias Old
 * @constructor
 */
function Old() { this.scene = new Scene(); }
Old.prototype.scene2 = function() { return this.scene; };
Old.prototype.run = function() {
  const a = this.scene2();
  a.reset();
  a.render();
  let x = y;
  let y = x;
  x.reset();
};
export default Old;
""",
    "empty.js": "",
    "open.js": "class Broken { m() { const a = new Clock(; a.",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([*FILES.items(), ("null.js", None)], "path string, content string").repartition(3)


def test_calls_go_to_the_type_of_their_value(spark, files):
    found = extract.symbols(files).persist()
    edges = {(r["source_name"], r["target_name"]) for r in extract.call_edges(files, found).collect() if r["edge_type"] == "call"}
    assert {t for s, t in edges if s == "Scene.render"} == {"Clock.reset", "Instant.reset", "Clock.tick"}
    assert {t for s, t in edges if s == "Scene.step"} == {"Clock.reset", "Instant.reset"}
    assert {t for s, t in edges if s == "Scene.mixed"} == set(), "a value of two types has none, and three classes have a reset"
    assert {t for s, t in edges if s == "Scene.own"} == {"Base.update", "Base.reset"}, "inherited members"
    assert {t for s, t in edges if s == "Scene.shadow"} == {"Scene.render"}
    assert {t for s, t in edges if s == "Old.run"} == {"Old.scene2", "Base.reset", "Scene.render"}
    untyped = {(r["source_name"], r["target_name"]) for r in extract.call_edges(files, found, typed=False).collect() if r["edge_type"] == "call"}
    assert ("Scene.render", "Clock.reset") not in untyped and untyped < edges


def test_types_of_values(spark, files):
    held = types.spread(types.facts(files).persist()).collect()
    of = lambda value: {r["type"] for r in held if r["value"] == value and not r["is_class"]}
    assert of("field:Scene.clock") == {"Clock"} and of("field:Scene._moment") == {"Instant"}
    assert of("Source/Core/Factory.js||makeClock()") == {"Clock"} and of("Source/Core/Factory.js||makeMoment()") == {"Instant"}
    assert of("Source/Core/Factory.js||viaHidden()") == {"Clock"} and of("Source/Scene/Scene.js|Scene.mixed|v") == {"Clock", "Instant"}
    assert of("result:Clock.tick") == {"Clock"} and of("result:Old.scene2") == {"Scene"}
    assert of("Source/Scene/Scene.js|Scene.step|reset") == set()


def test_classes_that_extend_each_other_end(spark):
    loop = spark.createDataFrame([("p", a, "extends", b, None) for a, b in (("A", "B"), ("B", "C"), ("C", "A"), ("D", "D"))], types.FACT_ROWS)
    assert {(r["class"], r["ancestor"], r["steps"]) for r in types.ancestors(loop).collect() if r["class"] == "A"} == {("A", "B", 1), ("A", "C", 2)}
    assert types.spread(loop.limit(0)).count() == 0

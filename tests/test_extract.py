"""The token relation of sources against a plain reader of one text, and on layouts that say what is covered."""

from __future__ import annotations

import pytest

from sparkloom.operators import extract

from . import plain_facts
from .test_project import APP

#: Unlike sources, by what they are about.
SOURCES = {
    "whole": APP,
    "empty": "",
    "mixed": 'import type { Props } from "./types";\nimport React, { createContext, useContext, useState } from "react";\nconst Deferred = await import("./deferred");\nconst AppContext = createContext(null);\nexport const App = () => {\n  const [count] = useState(0);\n  return <Route path="/home" />;\n};\nexport default function Button({ label }: Props) {\n  useContext(AppContext);\n  return <button>{label}</button>;\n}\nexport { Deferred };\n',
    "handlers": "export async function GET() { return Response.json({ jobs: [] }); }\nexport async function POST() { return 1; }\n",
    "classes": "export abstract class Shape<T> extends Base implements One {\n  draw() { return { a: [1, 2] }; }\n}\nexport default class extends Base {}\nclass Plain { x = 1 }\ndeclare const z: number;\n",
    "wrapped": "const C = memo(function C(p, { q, r }) { useMemo(() => [1, 2], []); return <a><b/></a> });\nconst D = React.forwardRef((props, ref) => <i/>);\nconst L = lazy(() => import('./l'));\nconst M = memo(Plain);\nexport var E = x => x + 1;\nlet F = async (a, b) => { await useThing(a, [b, 1]); };\n",
    "signs": "const r = /[\"'{]/g; const s = `a ${b} } import \"no\"`; // { use()\n/* export const no = 1; */\nconst Box = (p) => <a/>\nconst half = a / b / c;\nconst t = 'it\\'s {';\n",
    "lists": "export { a, b as default, type C, d as e } from './m';\nexport * as ns from \"n\";\nexport type { T } from './t';\nexport type * from './u';\nexport { f as g };\nfunction outer() { const q = { export: 1 }; }\nexport enum Kind { A }\n",
    "broken": "function a(x) { return [x; }\nconst = ;",
    "unclosed": "export function Valid() { return null; }\nconst x = { a: (1, [2]\n",
    "hooks": "function useOwn() { return useState<Array<number>>([1, { a: 2, b: 3 }]); }\nfunction View({ a = 1, ...rest }) {\n  const v = React.useCallback((e) => { f(e, 1); }, [a]);\n  useOwn();\n  usePlain;\n  return null;\n}\n",
    "wide": "const é = 'ß😀';\r\nimport x from \"é😀\";\r\nfunction Ünder() {}\r\nfunction Done(a) { /* 😀 */ return useIt('😀', a); }\r\n",
    "imports": "import a, * as b from 'm'\nimport {\n  c as d, // said { here }\n  type E,\n} from \"n\"\nimport 'side'\nimport type from './type'\nimport type D2 from './d2'\nconst y = import.meta.url; x.import('no')\n",
    "routes": "const r = <Routes><Route index path={'/a/:id'} element={<A/>}/><Route path=\"*\"><Route element={x}/></Route></Routes>;\n",
}


@pytest.fixture(scope="module")
def told(spark):
    rows = [(k, f"src/{k}.tsx" if k != "handlers" else "app/api/route.ts", t) for k, t in SOURCES.items()] + [("null", None, None)]
    done = extract.extract(spark.createDataFrame(rows, "file_id string, path string, text string"))
    return {r["file_id"]: r.asDict(recursive=True) for r in done.collect()}


@pytest.mark.parametrize("name", [n for n in SOURCES if n not in ("wide", "imports", "signs")])
def test_as_a_plain_reader(told, name):
    plain = plain_facts.facts(SOURCES[name], name == "handlers")
    for kind in extract.KINDS:
        order = lambda x: (x.get("position", 0), x.get("line", 0), str(x))
        assert sorted(told[name][kind], key=order) == sorted(plain[kind], key=order), kind


def test_null_and_empty(told):
    for name in ("null", "empty"):
        assert told[name]["module"] == [{"function_count": 0, "line_count": 1}]
        assert not any(told[name][k] for k in extract.KINDS if k != "module")


def test_signs_in_strings_and_comments(told):
    got = told["signs"]
    assert [s["name"] for s in got["symbols"]] == ["r", "s", "Box", "half", "t"] and not got["imports"] and not got["exports"] and not got["errors"] and not got["hooks"]
    assert [(c["name"], c["props"], c["jsx_depth"]) for c in got["components"]] == [("Box", ["p"], 1)]


def test_imports(told):
    assert [(i["source"], i["specifiers"], i["is_type_only"], i["is_dynamic"]) for i in told["imports"]["imports"]] == [
        ("m", ["a", "* as b"], False, False), ("n", ["d", "E"], False, False), ("side", [], False, False), ("./type", ["type"], False, False), ("./d2", ["D2"], True, False),
    ]


def test_places_count_characters(told):
    got, text = told["wide"], SOURCES["wide"]
    assert [i["source"] for i in got["imports"]] == ["é😀"] and got["hooks"] == [{"name": "useIt", "line": 4, "column": 35, "position": text.index("useIt"), "arguments": ["'😀'", "a"]}]
    assert [c["name"] for c in got["components"]] == ["Ünder", "Done"]


def test_expression_exports_on_request(spark):
    rows = [("1", "export default () => 1;"), ("2", "export default { a: 1 };"), ("3", "const x = 1;\nexport default x;\nconst y = () => 1;"), ("4", "export default async x => x"), ("5", "export default function () {}")]
    frame = spark.createDataFrame(rows, "file_id string, text string").selectExpr("file_id", "'a.ts' AS path", "text")
    for asked, want in ((True, {"1": True, "2": False, "3": False, "4": True, "5": True}), (False, {"5": True})):
        got = extract.kind_of(extract.extract(frame, expression_exports=asked), "exports").collect()
        assert {r["file_id"]: r["is_anonymous"] for r in got} == want and all(r["name"] == "default" and r["is_default"] for r in got)


def test_long_texts(spark):
    """Long strings, comments, templates and attributes overflow no stack, and deep brackets close."""
    n = 200_000
    text = f"const a = '{'x' * n}'; /* {'y' * n} */ const b = `{'z' * n}`; const c = \"{'w\\\\' * 1}{'q' * n}\";\nconst Deep = (p) => <i a={{'{'v' * n}'}}>{'(' * 500}{')' * 500}</i>;\n"
    got = extract.extract(spark.createDataFrame([("1", "a.tsx", text)], "file_id string, path string, text string")).collect()[0]
    assert [s["name"] for s in got["symbols"]] == ["a", "b", "c", "Deep"] and got["components"][0]["jsx_depth"] == 1 and not got["errors"]

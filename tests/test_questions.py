"""Questions on a small estate written for these tests."""

import pytest

from flowloom.operators import dedup, questions
from flowloom.sources import estate

FILES = {
    ".github/workflows/ci.yml": """name: CI
on:
  push: {branches: [main]}
  schedule:
    - cron: "0 1 * * *"
    - cron: "0 2 * * *"
permissions: {contents: read}
jobs:
  build:
    runs-on: x
    container: {image: "img:${{ inputs.none }}", env: {A: "${{ needs.other.outputs.z }}"}, ports: ["${{ inputs.port }}"]}
    if: github.ref == 'a'
    steps:
      - id: lint
        uses: ./tools/lint
        if: always()
        continue-on-error: ${{ inputs.soft }}
      - run: |
          echo ${{ steps.lint.outputs.used }}
          gh workflow run nightly.yml;
          gh workflow run "quoted.yml"
          # gh workflow run comment.yml
      # flowloom:dispatches .github/workflows/nightly.yml/
      - run: gh workflow run nightly.yml
        if: ok()
      - uses: ./tools/absent
  ship:
    needs: build
    uses: ./.github/workflows/deploy.yml
    with: {target: "${{ needs.ship.outputs.url }}"}
    secrets: {TOKEN: "${{ secrets.CI_TOKEN }}"}
""",
    ".github/workflows/deploy.yml": """on:
  workflow_call:
    inputs:
      target: {type: string, required: true}
      idle: {type: boolean, default: false}
    outputs:
      url: {value: "${{ jobs.go.outputs.url }}"}
      lost: {value: x}
    secrets:
      TOKEN: {required: true}
      EXTRA: {required: true}
      LOOSE: {required: false}
permissions: {contents: write}
jobs:
  go:
    runs-on: x
    environment: {name: prod, url: "https://${{ inputs.target }}"}
    steps: [{run: echo}]
  down:
    uses: ./.github/workflows/leaf.yml
    secrets: inherit
""",
    ".github/workflows/leaf.yml": "on: {workflow_call: {secrets: {ci_token: {required: true}, TOKEN: {required: true}}}}\njobs:\n  l:\n    runs-on: x\n    steps: [{uses: ./.github/workflows/deploy.yml}]\n",
    ".github/workflows/nightly.yml": "name: Nightly\non: {workflow_run: {workflows: [CI, Ghost]}}\njobs:\n  n: {runs-on: x, steps: [{uses: a/b@v1}]}\n",
    ".github/workflows/unused.yml": "on: workflow_call\njobs:\n  n: {runs-on: x, steps: [{uses: a/b@v2}]}\n  # flowloom:dispatches\n",
    "tools/lint/action.yml": """inputs: {level: {default: "1"}, quiet: {}}
outputs: {used: {value: "${{ inputs.level }}"}, unread: {value: y}}
runs:
  using: composite
  steps:
    # flowloom:triggers .github/workflows/nightly.yml
    - run: echo
      if: never()
    - uses: ./tools/lint/deep
      if: sometimes()
""",
    "tools/lint/deep/action.yaml": "runs: {using: node20, main: x.js}\ninputs: {free: {}}\n",
    "tools/alone/action.yml": "runs: {using: docker, image: x}\n",
}
CI, DEPLOY, LEAF, NIGHTLY, UNUSED = (f".github/workflows/{n}.yml" for n in ("ci", "deploy", "leaf", "nightly", "unused"))


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("asked")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    return estate.load(spark, str(root))


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def line_of(file, said):
    return next(k for k, line in enumerate(FILES[file].split("\n"), 1) if said in line)


def test_targets(spark, loaded):
    found = {r["path"]: (r["kind"], r["id"]) for r in questions.targets(loaded, paths(spark, "./" + CI, "tools/lint/action.yml", "tools/lint/deep/x/y.js", "tools/lint/", "other/x", CI.replace("ci", "gone"), None)).collect()}
    assert found == {
        "./" + CI: ("workflow", CI), "tools/lint/action.yml": ("action", "tools/lint"), "tools/lint/deep/x/y.js": ("action", "tools/lint/deep"),
        "tools/lint/": ("action", "tools/lint"), "other/x": ("unknown", None), CI.replace("ci", "gone"): ("unknown", None), None: ("unknown", None),
    }


def test_callers(spark, loaded):
    rows = questions.callers(loaded, paths(spark, NIGHTLY, DEPLOY, "tools/lint/deep")).orderBy("path", "pos").collect()
    assert [(r["path"], r["kind"], r["caller"], r["job_id"], r["step_ord"], r["verb"]) for r in rows] == [
        (DEPLOY, "JobCall", f"workflow:{CI}", "ship", None, None),
        (DEPLOY, "Step", f"workflow:{LEAF}", "l", 0, None),
        (NIGHTLY, "Annotated", f"workflow:{CI}", "build", 2, "dispatches"),
        (NIGHTLY, "AnnotatedComposite", "action:tools/lint", None, 0, "triggers"),
        ("tools/lint/deep", "CompositeStep", "action:tools/lint", None, 1, None),
    ]


def test_impact(spark, loaded):
    asked = lambda *names: {(r["kind"], r["id"], r["action_kind"]) for r in questions.impact(loaded, paths(spark, *names)).collect()}
    assert asked("tools/lint/deep/main.js") == {("workflow", CI, None), ("action", "tools/lint", "composite")}
    assert asked(NIGHTLY) == {("workflow", CI, None), ("action", "tools/lint", "composite")}
    assert asked(LEAF) == {("workflow", CI, None)} and asked(CI, "nothing") == set() and asked() == set()


def test_trace(loaded):
    rows = questions.trace(loaded, "push").orderBy("pos").collect()
    guarded = "(github.ref == 'a') && (always())"
    assert [(r["depth"], r["node"], r["edge_kind"], r["guard"], r["is_cycle"]) for r in rows] == [
        (0, f"workflow:{CI}", None, None, False),
        (1, "action:tools/lint", "uses", guarded, False),
        (2, f"workflow:{NIGHTLY}", "triggers", None, False),
        (3, "external-action:a/b@v1", "uses", None, False),
        (2, "action:tools/lint/deep", "uses", None, False),
        (1, f"workflow:{NIGHTLY}", "dispatches", "(github.ref == 'a') && (ok())", False),
        (2, "external-action:a/b@v1", "uses", None, False),
        (1, "action:tools/absent", "uses", "github.ref == 'a'", False),
        (1, f"workflow:{DEPLOY}", "call", None, False),
        (2, f"workflow:{LEAF}", "call", None, False),
        (3, f"workflow:{DEPLOY}", "uses", None, True),
    ]
    assert questions.trace(loaded, "issues").count() == 0


def test_orphans(loaded):
    assert {tuple(r) for r in questions.orphans(loaded).collect()} == {
        ("workflow", f"workflow:{UNUSED}", None), ("action", "action:tools/alone", None), ("input", f"workflow:{DEPLOY}", "idle"),
        ("input", "action:tools/lint", "quiet"), ("output", f"workflow:{DEPLOY}", "lost"), ("output", "action:tools/lint", "unread"),
    }


def test_expressions(loaded):
    said = {r["text"] for r in questions.expressions(loaded).where(f"owner = 'workflow:{CI}'").collect()}
    assert said >= {"img:${{ inputs.none }}", "${{ needs.other.outputs.z }}", "${{ inputs.soft }}"} and not any("port" in s for s in said)


def test_declarations_and_schedule(loaded):
    rows = {(r["what"], r["name"]): r for r in questions.declarations(loaded).where(f"owner = 'workflow:{DEPLOY}'").collect()}
    assert len(rows) == 7 and rows["input", "target"]["type"] == "string" and rows["input", "target"]["required"] and rows["input", "idle"]["default"] == "false"
    assert [r["crons"] for r in loaded.triggers.where("event = 'schedule'").collect()] == [["0 1 * * *", "0 2 * * *"]]


def test_wiring(loaded):
    rows = {(r["kind"], r["file"], r["line"], r["target"], r["reason"]) for r in questions.wiring(loaded).collect()}
    assert rows == {
        ("unannotated dispatch", CI, line_of(CI, "- run: |") + 1, "nightly.yml", None),
        ("dangling annotation", UNUSED, line_of(UNUSED, "# flowloom"), "", "empty"),
        ("dangling workflow_run", NIGHTLY, None, "Ghost", None),
        ("dangling local uses", CI, line_of(CI, "./tools/absent"), "tools/absent", None),
    }
    late = loaded.diagnostics.where("message like 'no job or step%'").collect()
    assert [(r["file"], r["line"]) for r in late] == [(UNUSED, line_of(UNUSED, "# flowloom"))]


def test_attach(spark, loaded):
    step = line_of(CI, "id: lint")
    lines = [(1, CI, step), (2, CI, step + 1), (3, CI, 2), (4, CI, None), (5, "tools/lint/x", 7), (6, "gone", 3), (7, None, 3), (8, CI, line_of(CI, "ship:")), (9, "tools/alone/Dockerfile", 4), (10, "tools/lint/x", 1)]
    found = questions.attach(loaded, spark.createDataFrame(lines, "n int, path string, start_line int")).orderBy("n").collect()
    assert [(r["node"], r["job_id"], r["step_ord"], r["confidence"]) for r in found] == [
        (f"workflow:{CI}", "build", 0, "exact"), (f"workflow:{CI}", "build", 0, "heuristic"), (f"workflow:{CI}", None, None, "exact"), (f"workflow:{CI}", None, None, "exact"),
        ("action:tools/lint", None, 0, "exact"), (None, None, None, "file_only"), (None, None, None, "file_only"), (f"workflow:{CI}", "ship", None, "exact"),
        ("action:tools/alone", None, None, "exact"), ("action:tools/lint", None, None, "exact"),
    ]


def test_near_duplicates(loaded):
    found = questions.features(loaded)
    assert {(r["kind"], r["token"]) for r in found.where(f"doc = '{NIGHTLY}'").collect()} == {("trigger", "workflow_run"), ("job", "n"), ("use", "ext:a/b")}
    pairs = dedup.similar_pairs(found).collect()
    assert [(r["a"], r["b"], round(r["similarity"], 4)) for r in pairs] == [(NIGHTLY, UNUSED, 0.85)]


def test_permissions_and_secrets(loaded):
    assert {(r["root"], r["node"], tuple(r["scopes"]), r["caller"], tuple(r["chain"])) for r in questions.escalations(loaded).collect()} == {(f"{CI}#ship", f"{DEPLOY}#{j}", ("contents",), f"{CI}#ship", (f"{CI}#ship",)) for j in ("go", "down")}
    rows = {(r["callee"], r["secret"], r["dropped_at"], r["kind"]) for r in questions.secrets(loaded).collect()}
    ci = f"workflow:{CI}"
    assert rows == {
        (f"workflow:{DEPLOY}", "EXTRA", ci, "MissingSecretPropagation"),
        (f"workflow:{LEAF}", "ci_token", ci, "SecretsInheritChainBreak"),
    }
    assert [(r["node"], r["job_id"], r["environment"]) for r in questions.shadowed_environments(loaded).collect()] == [(f"workflow:{DEPLOY}", "go", "prod")]

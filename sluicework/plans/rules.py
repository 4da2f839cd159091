"""The eleven rules as plans over a project's facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import comments as C
from ..functions import identity as I
from ..functions import paths as P
from ..operators import clones, diff, graph, health, lines
from ..sources.project import Project

#: id, category, severity
REGISTRY = (
    ("circular-dependencies", "drift", "warning"),
    ("code-duplicates", "drift", "warning"),
    ("complexity-hotspots", "drift", "warning"),
    ("unused-public-exports", "drift", "warning"),
    ("slop-empty-catch", "slop", "warning"),
    ("slop-narrative-comment", "slop", "info"),
    ("slop-unjustified-ignore", "slop", "info"),
    ("a11y-image-label", "accessibility", "warning"),
    ("a11y-icon-button-label", "accessibility", "warning"),
    ("a11y-form-field-label", "accessibility", "warning"),
    ("a11y-interactive-semantics", "accessibility", "warning"),
)
WCAG = {
    "a11y-image-label": ("1.1.1", "Non-text Content"),
    "a11y-icon-button-label": ("4.1.2", "Name, Role, Value"),
    "a11y-form-field-label": ("3.3.2", "Labels or Instructions"),
    "a11y-interactive-semantics": ("4.1.2", "Name, Role, Value"),
}
CONSERVATIVE = ("visibleForTesting", "internal", "visibleForOverriding", "pragma")
CODEGEN_BASES = ("Table", "DataClass", "View")
CODEGEN_NOTES = ("Collection", "DataClassName", "DriftDatabase", "Entity", "GenerateMocks", "HiveType", "JsonSerializable", "Riverpod", "RoutePage", "freezed", "injectable", "module", "riverpod")
CODEGEN_PARTS = (".config.dart", ".freezed.dart", ".g.dart", ".gr.dart", ".mocks.dart", ".pb.dart")
#: Declarations whose comments are looked at.
TOLD_KINDS = ("class", "method", "getter", "setter", "operator", "function", "constructor")
#: Widgets of Flutter itself that can be tapped: a call of one of these names isn't of another package.
FLUTTER_TAPPED = (
    "ActionChip", "BackButton", "BottomNavigationBar", "CarouselView", "CheckboxMenuButton", "ChoiceChip", "CloseButton", "CupertinoActionSheetAction", "CupertinoButton",
    "CupertinoContextMenuAction", "CupertinoDialogAction", "CupertinoListTile", "CupertinoNavigationBarBackButton", "CupertinoTabBar", "CupertinoTextField", "DataCell", "DataRow",
    "DrawerButton", "DropdownButton", "DropdownButtonFormField", "DropdownMenuItem", "ElevatedButton", "EndDrawerButton", "FilledButton", "FilterChip", "FloatingActionButton",
    "GestureDetector", "IconButton", "InkResponse", "InkWell", "InputChip", "ListTile", "LongPressGestureRecognizer", "MaterialButton", "MenuItemButton", "OutlinedButton",
    "PopupMenuItem", "RadioMenuButton", "RawChip", "RawMaterialButton", "SearchAnchor", "SearchBar", "SelectableText", "Semantics", "SnackBarAction", "SubmenuButton", "TabBar",
    "TableRowInkWell", "TapGestureRecognizer", "TextButton", "TextField", "TextFormField",
)
PHRASES = ("constructor", "getter", "setter", "build method")
TAPS = ("onTap", "onPressed", "onLongPress")
COLUMNS = ("rule_id", "severity", "file_path", "line", "column", "message", "kind", "remedy", "wcag", "fingerprint")


def finding(rows: DataFrame, rule: str, anchor: Column, message: Column, kind: Column | str, remedy: Column | str, path: str = "path", line: str = "line", column: Column | None = None) -> DataFrame:
    severity = next(s for r, _, s in REGISTRY if r == rule)
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    note = WCAG.get(rule)
    wcag = F.struct(F.lit(note[0]).alias("number"), F.lit(note[1]).alias("title")) if note else F.lit(None).cast("struct<number:string,title:string>")
    return rows.select(
        F.lit(rule).alias("rule_id"),
        F.lit(severity).alias("severity"),
        F.col(path).alias("file_path"),
        F.col(line).cast("int").alias("line"),
        (F.lit(None) if column is None else column).cast("int").alias("column"),
        message.alias("message"),
        lit(kind).alias("kind"),
        lit(remedy).alias("remedy"),
        wcag.alias("wcag"),
        I.fingerprint(F.lit(rule), F.col(path), anchor).alias("fingerprint"),
    )


def facts(p: Project, kind: str, generated: bool = False, parts: bool = True) -> DataFrame:
    """Facts of a kind; files that can't be parsed have none. generated, parts: whether to take those of such files."""
    if p.kinds is not None and kind not in p.kinds:
        raise ValueError(f"facts of the kind {kind} weren't asked for")
    rows = p.facts.where(F.col("fact") == kind).where("path is not null")
    if not generated:
        rows = rows.where(~P.generated(F.col("path")))
    return rows if parts else rows.where("not is_part")


def import_edges(p: Project) -> DataFrame:
    """Import edges between the project's own lib files; exports and parts make none."""
    nodes = p.files.where("status = 'ok' and not is_generated and not is_part").where(P.under_lib(F.col("path"))).select("path")
    rows = facts(p, "uri", parts=False).where("name = 'import'").where(P.under_lib(F.col("path"))).select(F.col("path").alias("src"), F.col("props")["target"].alias("dst"))
    return graph.clean_edges(rows.join(nodes.withColumnRenamed("path", "dst"), "dst", "left_semi"))


def circular_dependencies(p: Project, dirs) -> DataFrame:
    rows = graph.cycles(import_edges(p)).withColumn("line", F.lit(1))
    chain = F.array_join("members", " -> ")
    return finding(rows, "circular-dependencies", F.array_join("members", "\n"), F.concat(F.lit("Files import each other: "), chain), F.col("kind"), "Move what they share into a file that imports neither.", "root")


def code_duplicates(p: Project, dirs) -> DataFrame:
    bodies = facts(p, "body", parts=False).where(P.in_dirs(F.col("path"), dirs)).select("path", F.col("line").alias("start"), "end_line", F.col("pre").alias("block"), "items")
    found = clones.renamed_clusters(bodies, ["path", "start", "end_line", "block"])
    first = F.col("blocks")[0]
    place = lambda b: F.concat(b["path"], F.lit(":"), b["start"].cast("string"))
    rows = found.select("token_count", "blocks", first["path"].alias("path"), first["start"].alias("line"))
    anchor = F.concat(F.lit("tokens="), F.col("token_count").cast("string"), F.lit("\n"), F.array_join(F.array_sort(F.transform("blocks", place)), "\n"))
    message = F.concat(F.size("blocks").cast("string"), F.lit(" bodies of "), F.col("token_count").cast("string"), F.lit(" tokens are equal but for names: "), F.array_join(F.transform("blocks", place), ", "))
    return finding(rows, "code-duplicates", anchor, message, "duplicated-block", "Keep one of them and call it.")


def complexity(p: Project, dirs) -> DataFrame:
    """(file_path, line, qualified_name, cyclomatic, cognitive, is_build) of every executable body."""
    units = facts(p, "unit").where(P.in_dirs(F.col("path"), dirs)).select("path", "pre", "line", F.col("name").alias("qualified_name"), (F.col("props")["build"] == "true").alias("is_build"))
    flag = lambda k: F.col("props")[k]
    points = facts(p, "point").select("path", "pre", flag("cyc").cast("int").alias("cyc"), flag("cog").cast("int").alias("cog"), flag("depth").cast("int").alias("depth"), (flag("nested") == "true").alias("nested"))
    return health.metrics(units, points, ["path", "pre"]).withColumnRenamed("path", "file_path")


def complexity_hotspots(p: Project, dirs) -> DataFrame:
    rows = health.hotspots(complexity(p, dirs))
    kind = F.when(F.col("is_build"), "flutter-widget-build").otherwise("logic")
    remedy = F.when(F.col("is_build"), "Take parts of the tree out into widgets of their own.").otherwise("Take branches out into functions of their own.")
    return finding(rows, "complexity-hotspots", F.col("qualified_name"), F.concat(F.col("qualified_name"), F.lit(" is hard to follow: "), F.col("breach")), kind, remedy, "file_path")


def supertypes(p: Project) -> DataFrame:
    return graph.closure(facts(p, "supertype", True).where("props['clause'] <> 'on'").select(F.col("name").alias("src"), F.col("props")["super"].alias("dst")))


def codegen_reason(supers: Column, notes: Column, has_part: Column) -> Column:
    """Why a generator reads a class, the first that holds: a supertype, an annotation, or a generated part that it binds."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    first = lambda xs, known: F.element_at(F.array_intersect(F.array_sort(xs), lit(known)), 1)
    return (
        F.when(F.arrays_overlap(supers, lit(CODEGEN_BASES)), F.concat(F.lit("base type "), first(supers, CODEGEN_BASES)))
        .when(F.arrays_overlap(notes, lit(CODEGEN_NOTES)), F.concat(F.lit("annotation "), first(notes, CODEGEN_NOTES)))
        .when(has_part & F.exists(supers, lambda x: x.startswith("_$")), "generated part")
    )


def codegen_inputs(p: Project) -> DataFrame:
    """(path, name, reason) of classes, mixins and enums that a generator reads; supertypes count at any distance."""
    decls = facts(p, "decl").where("props['kind'] in ('class', 'mixin', 'enum') and owner is null").select("path", "name", "items")
    above = graph.closure(facts(p, "supertype", True).select(F.col("name").alias("src"), F.col("props")["super"].alias("dst")))
    supers = above.groupBy(F.col("src").alias("name")).agg(F.collect_set("dst").alias("supers"))
    made = facts(p, "uri").where("name = 'part'").where(P.any_end(F.col("props")["uri"], CODEGEN_PARTS)).select("path").distinct().withColumn("has_part", F.lit(True))
    rows = decls.join(supers, "name", "left").join(made, "path", "left")
    none = F.array().cast("array<string>")
    reason = codegen_reason(F.coalesce("supers", none), F.coalesce("items", none), F.coalesce("has_part", F.lit(False)))
    return rows.select("path", "name", reason.alias("reason")).where("reason is not null")


def eligible(name: Column, notes: Column) -> Column:
    """Whether a declaration of this name and with these annotations may be reported as unused."""
    noted = F.arrays_overlap(F.coalesce(notes, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in CONSERVATIVE]))
    return (name != "") & ~name.startswith("_") & (name != "main") & ~F.coalesce(noted, F.lit(False))


def with_owners(references: DataFrame, members: DataFrame, name: str, owner: str) -> DataFrame:
    """Distinct references, and the owners of members that are referred to."""
    refs = references.select(name).distinct()
    live = members.join(refs, name, "left_semi").select(F.col(owner).alias(name))
    return refs.union(live).distinct()


def unused_public_exports(p: Project, dirs) -> DataFrame:
    decls = facts(p, "decl").where(P.under_lib(F.col("path")))
    name, kind, owner = F.col("name"), F.col("props")["kind"], F.col("owner")
    plain = decls.where(eligible(name, F.col("items")))
    exported = facts(p, "uri", True).where("name = 'export'").select(F.col("props")["target"].alias("path")).distinct()
    plain = plain.join(exported, "path", "left_anti").join(codegen_inputs(p).select("path", "name"), ["path", "name"], "left_anti")
    top = plain.where(owner.isNull())
    # members of types that could be reported themselves, but for what a supertype asks for
    types = top.where(kind.isin("class", "mixin", "enum", "extension")).select("path", F.col("name").alias("owner"))
    member = plain.where(owner.isNotNull() & kind.isin("method", "getter", "setter", "field") & (F.coalesce(F.col("props")["abstract"], F.lit("false")) != "true") & (F.coalesce(F.col("props")["override"], F.lit("false")) != "true"))
    member = member.join(types, ["path", "owner"], "left_semi")
    inherited = supertypes(p).join(facts(p, "decl", True).where("owner is not null").select(F.col("owner").alias("dst"), "name"), "dst").select(F.col("src").alias("owner"), "name").distinct()
    member = member.join(inherited, ["owner", "name"], "left_anti").withColumn("anchor", F.concat("owner", F.lit("."), "name"))
    # what a project class inherits from outside can't be seen: names count as used there
    extension = facts(p, "decl").where("props['kind'] = 'extension'").select(F.col("name").alias("owner")).distinct()
    used = with_owners(facts(p, "ref", True), facts(p, "decl").where("owner is not null").join(extension, "owner", "left_semi"), "name", "owner")
    rows = diff.unused(top.withColumn("anchor", name).unionByName(member, allowMissingColumns=True), used, key="name")
    rows = rows.groupBy("path", "anchor").agg(F.min(F.struct("line", "col", F.col("props")["kind"].alias("kind"))).alias("m")).select("path", "anchor", "m.line", "m.col", "m.kind")
    if p.profile.is_publishable:
        rows = rows.where(~P.public_api(F.col("path")))
    return finding(rows, "unused-public-exports", F.col("anchor"), F.concat(F.lit("Nothing refers to "), F.col("kind"), F.lit(" "), F.col("anchor")), "unused-public-export", "Delete it or make it private.", column=F.col("col"))


def _numbered(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return lines.with_occurrence(rows, ["path", *key], [order])


def slop_empty_catch(p: Project, dirs) -> DataFrame:
    rows = _numbered(facts(p, "catch").where("props['tokens'] = '0'").fillna({"name": ""}), ["name"], "seq")
    return finding(rows, "slop-empty-catch", F.concat("name", F.lit(":catch:"), F.col("occurrence").cast("string")), F.concat(F.lit("An error is swallowed in "), F.col("name")), "empty-catch", "Handle it, log it or let it pass.", column=F.col("col"))


def told(said: Column, name: Column) -> Column:
    """Whether a comment only repeats what it stands above. Both in lower case."""
    plain = [F.concat(F.lit("the "), name, F.lit(f" {what}")) for what in ("method", "widget")]
    return (said != "") & ((said == name) | said.isin(*PHRASES) | (said == plain[0]) | (said == plain[1]))


def slop_narrative_comment(p: Project, dirs) -> DataFrame:
    notes = lines.last_by(facts(p, "comment").where("props['style'] = 'line'"), ["path", "seq"], ["line", "col"], ["line", "name", "col"])
    decls = facts(p, "decl").where(F.col("props")["kind"].isin(*TOLD_KINDS)).select("path", "seq", F.col("line").alias("decl_line"), F.col("name").alias("decl"), "owner", "props")
    label = F.coalesce(F.col("props")["label"], F.col("decl"))
    rows = notes.join(decls, ["path", "seq"]).where("decl_line - line = 1").where(told(C.normal_comment(F.col("name")), F.lower("decl")))
    rows = _numbered(rows.select("path", "seq", "line", "col", label.alias("label")), ["label"], "seq")
    return finding(rows, "slop-narrative-comment", F.concat("label", F.lit(":narrative-comment:"), F.col("occurrence").cast("string")), F.concat(F.lit("The comment only repeats "), F.col("label")), "narrative-comment", "Say why, or drop it.", column=F.col("col"))


def slop_unjustified_ignore(p: Project, dirs) -> DataFrame:
    files = p.files.where("status = 'ok' and not is_generated")
    rows = lines.with_previous(lines.lines(files, ["path"], "content"), ["path"], "line_no", C.is_comment(F.col("line")))
    rest = F.regexp_extract("line", C.IGNORE, 2)
    rows = rows.where(F.col("line").rlike(C.IGNORE)).withColumn("directive", C.ignore_kind(F.col("line"))).withColumn("lints", C.lint_names(rest))
    bare = (C.reason(rest) == "") & ~F.col("previous")
    rows = rows.where(bare).select("path", F.col("line_no").alias("at"), "directive", "lints", F.instr("line", "//").alias("col"))
    rows = _numbered(rows, ["directive", "lints"], "at")
    anchor = F.concat_ws(":", "directive", "lints", F.col("occurrence").cast("string"))
    return finding(rows, "slop-unjustified-ignore", anchor, F.concat(F.lit("No reason is given for ignoring "), F.col("lints")), "unjustified-ignore", "Say why on the same line or the line above.", line="at", column=F.col("col"))


def _nodes(p: Project) -> DataFrame:
    """Constructor calls with what is known of their class: Flutter's (``flutter``), the project's (``own``) or another package's (``foreign``).

    A file that imports Flutter, or is a part, may call Flutter's classes, but for names that the project declares. A
    class is taken for another package's if its file imports one and Flutter has no widget of that name to be tapped.
    child_own and decoration_own: whether the class of that argument is the project's.
    """
    own = facts(p, "decl", True).where("props['kind'] = 'class' and owner is null").select("name").distinct().withColumn("own", F.lit(True))
    uri = F.col("props")["uri"]
    seen = facts(p, "uri").where("name in ('import', 'part of')").groupBy("path").agg(
        F.bool_or(uri.startswith("package:flutter/") | (F.col("name") == "part of")).alias("flutter"),
        F.bool_or(uri.startswith("package:") & ~uri.startswith("package:flutter/") & (F.col("props")["target"] == "")).alias("foreign"),
    )
    rows = facts(p, "node").join(own, "name", "left").join(seen, "path", "left")
    for arg in ("child", "decoration"):
        mine = own.select(F.col("name").alias("__class"), F.col("own").alias(f"{arg}_own"))
        rows = rows.join(mine, F.regexp_extract(_arg(arg), r"^new (\w+)\(", 1) == F.col("__class"), "left").drop("__class")
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumns({c: no(F.col(c)) for c in ("own", "flutter", "foreign", "child_own", "decoration_own")})
    foreign = F.col("foreign") & ~F.col("own") & ~F.col("name").isin(*FLUTTER_TAPPED)
    return rows.withColumns({"flutter": F.col("flutter") & ~F.col("own"), "foreign": foreign}).fillna({"owner": ""})


def _arg(name: str) -> Column:
    return F.col("props")[f"arg:{name}"]


def _unlabelled(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows without those inside a labelled Semantics call of the same file."""
    label = nodes.where("flutter and name = 'Semantics'").where(_arg("label").isNotNull())
    return lines.outside(rows, label, ["path"], "pre", "post")


def a11y_image_label(p: Project, dirs) -> DataFrame:
    rows = _nodes(p).where("flutter and name = 'Image'").where(_arg("semanticLabel").isNull() & (F.coalesce(_arg("excludeFromSemantics"), F.lit("")) != "true"))
    return finding(rows, "a11y-image-label", F.concat("owner", F.lit(":"), F.col("props")["variant"]), F.lit("An image has no description"), "missing-semantic-label", "Give it a semanticLabel or exclude it from semantics.", column=F.col("col"))


def _widget_finding(rows: DataFrame, rule: str, message: Column, kind: str, remedy: str) -> DataFrame:
    rows = _numbered(rows, ["owner", "name"], "post")
    return finding(rows, rule, F.concat_ws(":", "owner", "name", F.col("occurrence").cast("string")), message, kind, remedy, column=F.col("col"))


def a11y_icon_button_label(p: Project, dirs) -> DataFrame:
    nodes = _nodes(p)
    button = (F.col("name") == "IconButton") & _arg("tooltip").isNull()
    area = F.col("name").isin("GestureDetector", "InkWell") & F.coalesce(_arg("child"), F.lit("")).startswith("new Icon(") & ~F.col("child_own")
    return _widget_finding(_unlabelled(nodes.where(F.col("flutter") & (button | area)), nodes), "a11y-icon-button-label", F.concat(F.col("name"), F.lit(" has no accessible name")), "missing-accessible-name", "Give it a tooltip or wrap it in labelled Semantics.")


def a11y_form_field_label(p: Project, dirs) -> DataFrame:
    nodes, decoration = _nodes(p), F.coalesce(_arg("decoration"), F.lit(""))
    bare = (decoration == "") | (decoration.startswith("new InputDecoration(") & ~F.col("decoration_own") & ~decoration.rlike(r"[(,](labelText|hintText)[,)]"))
    rows = nodes.where(F.col("flutter") & F.col("name").isin("TextField", "TextFormField") & bare)
    return _widget_finding(_unlabelled(rows, nodes), "a11y-form-field-label", F.concat(F.col("name"), F.lit(" has no label")), "missing-form-label", "Give its decoration a labelText or hintText.")


def a11y_interactive_semantics(p: Project, dirs) -> DataFrame:
    nodes = _nodes(p)
    tapped = F.coalesce(*[_arg(a) for a in TAPS]).isNotNull()
    named = F.coalesce(*[F.when(~_arg(a).isin("null", "''", '""'), _arg(a)) for a in ("label", "semanticLabel", "tooltip")]).isNotNull()
    rows = nodes.where((F.col("own") | F.col("foreign")) & tapped & ~named)
    return _widget_finding(_unlabelled(rows, nodes), "a11y-interactive-semantics", F.concat(F.col("name"), F.lit(" can be tapped but has no accessible name")), "missing-accessible-name", "Give it a label or wrap it in labelled Semantics.")


RULES = {
    "circular-dependencies": circular_dependencies,
    "code-duplicates": code_duplicates,
    "complexity-hotspots": complexity_hotspots,
    "unused-public-exports": unused_public_exports,
    "slop-empty-catch": slop_empty_catch,
    "slop-narrative-comment": slop_narrative_comment,
    "slop-unjustified-ignore": slop_unjustified_ignore,
    "a11y-image-label": a11y_image_label,
    "a11y-icon-button-label": a11y_icon_button_label,
    "a11y-form-field-label": a11y_form_field_label,
    "a11y-interactive-semantics": a11y_interactive_semantics,
}


def directives(p: Project) -> DataFrame:
    """(file_path, line, rule_id) of valid suppressions."""
    rows = facts(p, "comment", True).select("path", "line", C.directive_rule(F.col("name")).alias("rule_id")).where("rule_id is not null")
    return rows.select(F.col("path").alias("file_path"), "line", "rule_id").distinct()


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], "rule_id string, severity string, file_path string, line int, `column` int, message string, kind string, remedy string, wcag struct<number:string,title:string>, fingerprint string")

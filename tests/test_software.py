"""Calls, arguments and interfaces of instructions on small hand-written projects; typed values."""

from pyspark.sql import functions as F

from assayer.operators import parameters
from assayer.plans import software
from assayer.sources import projects

DEFINITION = """<AddOnInstructionDefinition Name="{0}"><Parameters><Parameter Name="EnableIn" Usage="Input" Required="false"/><Parameter Name="Level" Usage="Input" Required="true"/><Parameter Name="Level" Usage="Output" Required="true"/><Parameter Name="Alarm" Usage="Output" Required="true"/><Parameter Name="Limit" Usage="InOut" Required="false"/></Parameters><LocalTags><LocalTag Name="Seen" DataType="DINT" Dimensions="4"/></LocalTags></AddOnInstructionDefinition>"""
PROJECT = """<RSLogix5000Content TargetName="A" TargetType="Controller"><Controller Use="Target" Name="A">
<Modules><Module Name="Rack" ParentModule="Local"/><Module Name="Rack:2" ParentModule="Rack"/></Modules>
<AddOnInstructionDefinitions>{0}</AddOnInstructionDefinitions><Tags><Tag Name="Out" DataType="BOOL"/></Tags>
<Programs><Program Name="P"><Tags><Tag Name="Tank1" DataType="WATCH"/><Tag Name="Tank2" DataType="Twice"/><Tag Name="out" DataType="BOOL"/></Tags><Routines><Routine Name="R" Type="RLL"><RLLContent>
<Rung Number="0"><Text>watch(Tank1,Rack:2:I.Ch0Data,Limit:=Max,Out,Spare);</Text></Rung><Rung Number="1"><Text>Twice(Tank2,Rack);Unknown(x);</Text></Rung></RLLContent></Routine></Routines></Program></Programs></Controller></RSLogix5000Content>"""


def test_calls_and_arguments(spark, tmp_path):
    (tmp_path / "a.L5X").write_text(PROJECT.format(DEFINITION.format("Watch") + DEFINITION.format("Twice")))
    (tmp_path / "b.L5X").write_text(PROJECT.replace('Name="P"', 'Name="Q"').replace("watch(", "none(").format(DEFINITION.format("twice")))
    elements = projects.read_projects(spark, str(tmp_path)).persist()
    own = elements.where("workspace like '%a.L5X'")
    assert [(r["name"], r["flow"], r["required_position"]) for r in software.parameters(own).where("instruction = 'Watch'").orderBy("ordinal").collect()] == [("EnableIn", "input", None), ("Level", "input", 1), ("Alarm", "output", 2), ("Limit", "inout", None)]
    assert [(r["name"], r["dimensions"]) for r in software.local_tags(own).where("instruction = 'Watch'").collect()] == [("Seen", 4)]
    status = {(r["program"], r["tag"]): (r["definition"], r["status"]) for r in software.instances(elements).collect()}
    assert status == {("P", "Tank1"): ("Watch", "resolved"), ("P", "Tank2"): (None, "ambiguous"), ("Q", "Tank1"): ("Watch", "resolved"), ("Q", "Tank2"): (None, "ambiguous")}
    assert sorted((r["callee"], r["status"]) for r in software.resolved_calls(elements).where("program = 'P'").collect()) == [("Twice", "ambiguous"), ("watch", "resolved")]
    bound = {r["position"]: (r["role"], r["parameter"], r["flow"], r["tag_key"]) for r in software.argument_bindings(elements).where("program = 'P'").collect()}
    assert bound == {0: ("instance", None, None, "program:P:Tank1"), 1: ("parameter", "Level", "input", None), 2: ("parameter", "Limit", "inout", None), 3: ("parameter", "Alarm", "output", "program:P:out"), 4: ("unmatched", None, None, None)}
    found = {r["operand"]: (r["module"], r["path"], r["direction"]) for r in software.module_operands(own).collect()}
    assert found == {"Rack:2:I.Ch0Data": ("Rack:2", "I.Ch0Data", "input"), "Rack": ("Rack", None, "unknown")}
    assert [(r["instance"], r["calls"], r["modules"]) for r in software.software_modules(elements).where("program = 'P'").collect()] == [("program:P:Tank1", 1, ["Rack:2"])]


def test_typed_values(spark):
    rows = spark.createDataFrame([("BOOL", "TRUE"), ("BOOL", "2"), ("bool", " 0 "), ("LINT", "2#101"), ("DINT", "x"), ("REAL", "1e3"), ("STRING", "1"), (None, "1")], "t string, v string")
    got = [tuple(r) for r in rows.select(*parameters.scalar_value(F.col("t"), F.col("v")).values()).collect()]
    assert got == [(True, None, None), (None, None, None), (False, None, None), (None, 5, None), (None, None, None), (None, None, 1000.0), (None, None, None), (None, None, None)]
    image = parameters.packed_image(4, [(0, 2, F.lit(-2)), (2, 1, F.lit(300))], [(2, 7, F.lit(True)), (3, 0, F.lit(False))])
    assert bytes(spark.range(1).select(image).first()[0]) == b"\xfe\xff\xac\x00"

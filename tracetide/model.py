"""Schemas of the tables that every waveform source yields, and the words of its catalog."""

from __future__ import annotations

META = "file string, file_format string, date string, version string, timescale_factor int, timescale_unit string, timescale_exponent int, comments array<string>"
SCOPES = "file string, scope_id bigint, parent_id bigint, ord int, name string, path array<string>, full_name string, scope_type string, pack string, component string, decl_path string, decl_line bigint, inst_path string, inst_line bigint"
VARS = "file string, var_id bigint, parent_id bigint, ord int, name string, path array<string>, full_name string, var_type string, direction string, msb bigint, lsb bigint, signal_id bigint, enum_id int, vhdl_type_name string"
SIGNALS = "file string, signal_id bigint, encoding string, width int, kind string, id_code string"
DERIVED = "file string, signal_id bigint, pos int, input_signal_id bigint, msb int, lsb int"
ENUMS = "file string, enum_id int, name string, mapping array<struct<value:string,label:string>>"

# The words of VCD headers, and the numbers that VHDL attributes use.
SCOPE_TYPES = frozenset("module task function begin fork generate struct union class interface package program vhdl_architecture vhdl_procedure vhdl_function vhdl_record vhdl_process vhdl_block vhdl_for_generate vhdl_if_generate vhdl_generate vhdl_package unknown clocking sv_array".split())
VAR_TYPES = frozenset("wire reg parameter integer string event real real_parameter supply0 supply1 time tri triand trior trireg tri0 tri1 wand wor logic port sparray realtime bit int shortint longint byte enum shortreal".split())
REAL_TYPES = frozenset("real realtime shortreal real_parameter".split())
VHDL_DATA_TYPES = {1: "boolean", 2: "bit", 3: "bit_vector", 4: "std_ulogic", 5: "std_ulogic_vector", 6: "std_logic", 7: "std_logic_vector"}
TIME_UNITS = {"zs": -21, "as": -18, "fs": -15, "ps": -12, "ns": -9, "us": -6, "ms": -3, "s": 0}

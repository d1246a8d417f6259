"""Canonical tables of the engine."""

FRAMES = (
    "source_id string, ordinal bigint, t_us bigint, ts double, can_id int, extended boolean, direction string, "
    "channel int, dlc_code int, data_length int, data binary"
)
SAMPLES = "source_id string, ordinal bigint, seq int, signal_id string, t_us bigint, ts double, value double, quality string, value_label string"
DIAGNOSTICS = "source_id string, origin string, code string, severity string, message string, position double"
LAYOUTS = (
    "def_id string, can_id int, extended boolean, signal_id string, name string, unit string, byte_offset int, bit_offset int, "
    "length_bits int, signedness string, byte_order string, scale string, offset string, mux_role string, mux_ranges array<struct<lo:bigint,hi:bigint>>"
)
#: CAN FD payload length by DLC code (fixed values of the bus standard).
FD_LENGTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64)
#: Largest whole number that a double holds exactly.
SAFE_INTEGER = 2**53 - 1

"""Part of the engine: functions."""

"""Transit analytics on Spark: timetables, realtime overlays, spatial matching and routing as DataFrame plans."""

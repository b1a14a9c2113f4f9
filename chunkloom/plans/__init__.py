"""Index generations, planning, applying, configuration and migration."""

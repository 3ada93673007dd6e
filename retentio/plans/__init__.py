"""End-to-end jobs: training (features -> label -> fit -> metrics -> save) and
scoring (features -> scores -> analysis tables)."""

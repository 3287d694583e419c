"""DataFrame -> DataFrame operators over (series_id, date, price) panels."""

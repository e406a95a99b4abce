"""Reading block tables: header layout, field codecs, files, and the Spark data source."""

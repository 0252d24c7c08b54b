"""Sources and sinks: study files in, PNG, DICOM and JSON out."""

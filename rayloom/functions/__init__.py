"""Column functions: pixels, request and DICOM text, geometry, progress timing."""
